"""Analytics over corpora of code artifacts, expressed as Spark DataFrame jobs."""
