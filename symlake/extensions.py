"""User extensions: extractors, container types and source providers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlake.operators.postings import build_postings
from symlake.operators.resolve import source_coverage
from symlake.session import Scratch
from symlake.sources.classify import EXTRACTOR_RULES, classify
from symlake.sources.containers import container_types

Extractor = Callable[[DataFrame], DataFrame]


@dataclass
class Extensions:
    """What a user adds. Extractors take the entries their selector picks and return posting rows."""

    extractors: dict[str, tuple[str, str | None, Extractor]] = field(default_factory=dict)
    container_rules: list[tuple[str, Column]] = field(default_factory=list)
    sources: list[DataFrame] = field(default_factory=list)

    def register_extractor(self, name: str, selectors: str, fn: Extractor, path_regex: str | None = None) -> None:
        """``selectors`` is a blank-separated list such as ``*:file:*.cfg``; a later registration of the same
        selector wins."""
        self.extractors[name] = (selectors, path_regex, fn)

    def register_container_type(self, kind: str, condition: Column) -> None:
        """``condition`` is an aggregate over the entries of a container, tried before the generic type."""
        self.container_rules.append((kind, condition))

    def register_source(self, provider: DataFrame) -> None:
        self.sources.append(provider)

    def container_types(self, entries: DataFrame) -> DataFrame:
        return container_types(entries, self.container_rules)

    def source_coverage(self, classes: DataFrame) -> DataFrame:
        return source_coverage(classes, self.sources)

    def route(self, entries: DataFrame) -> DataFrame:
        """``entries`` with the name of the extractor that is responsible, null without one."""
        own = [(name, selectors, regex) for name, (selectors, regex, _) in self.extractors.items()]
        return classify(entries, EXTRACTOR_RULES, own, out="extractor")

    def run(self, entries: DataFrame, built_in: dict[str, Extractor] | None = None) -> DataFrame:
        """Postings of all extractors, each over its own slice. The route is decided on the path; what is routed is
        written once, by extractor, so the corpus is opened once however many extractors there are."""
        fns = {**(built_in or {}), **{name: fn for name, (_, _, fn) in self.extractors.items()}}
        target = Scratch(entries.sparkSession, "routed").path("entries")
        routed = self.route(entries).filter(F.col("extractor").isin(list(fns)))
        routed.write.partitionBy("extractor").parquet(target)
        once = entries.sparkSession.read.schema(routed.schema).parquet(target)
        parts = [fn(once.filter(F.col("extractor") == name).drop("extractor")) for name, fn in fns.items()]
        return build_postings(reduce(DataFrame.unionByName, parts))
