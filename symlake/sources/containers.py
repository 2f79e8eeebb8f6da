"""Container types and traits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Container types in the order they are tried, with the path that marks an exploded directory.
CONTAINER_RULES = [
    ("kar", "repository"),
    ("jmod", "classes"),
    ("ear", "META-INF/application.xml"),
    ("war", "WEB-INF"),
    ("jar", "META-INF"),
]
EJB_MARKER = "META-INF/ejb-jar.xml"


def _has(marker: str) -> Column:
    """A marker counts when it is an entry or the directory of one."""
    path = F.col("entry_path")
    return F.max((path == marker) | path.startswith(marker + "/"))


def container_types(entries: DataFrame, extra: list[tuple[str, Column]] | None = None) -> DataFrame:
    """``(container, container_type)``. The suffix decides for archives, the marker for exploded directories
    (containers whose name has no archive suffix); ``extra`` lists own rules ``(type, aggregate condition)``
    tried before the generic type. One partial aggregate per container, nothing is collected."""
    archive = F.lower(F.substring_index("container", ".", -1))
    known = [kind for kind, _ in CONTAINER_RULES] + ["zip", "aar"]
    verdict = F.lit(None).cast("string")
    for kind, condition in reversed(extra or []):
        verdict = F.when(F.col(f"_x_{kind}"), kind).otherwise(verdict)
    for kind, _ in reversed(CONTAINER_RULES):
        verdict = F.when((archive == kind) | (~archive.isin(known) & F.col(f"_m_{kind}")), kind).otherwise(verdict)
    aggs = [_has(marker).alias(f"_m_{kind}") for kind, marker in CONTAINER_RULES]
    aggs += [condition.alias(f"_x_{kind}") for kind, condition in extra or []]
    return entries.groupBy("container").agg(*aggs).select(
        "container", F.coalesce(verdict, F.lit("generic")).alias("container_type"))


def container_traits(entries: DataFrame, marker: str = EJB_MARKER) -> DataFrame:
    """``(container, is_ejb_module)``."""
    return entries.groupBy("container").agg(F.max(F.col("entry_path") == marker).alias("is_ejb_module"))
