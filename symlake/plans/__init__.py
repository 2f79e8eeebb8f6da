"""Ready-made queries over the supplied tables, each with an equivalent SQL text where SQL can say it."""
