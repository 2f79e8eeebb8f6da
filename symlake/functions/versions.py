"""Class file versions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from symlake.functions.names import _col

# First class file major version of each language feature.
FEATURE_SINCE = {
    "enums": 49,
    "invokedynamic": 51,
    "lambdas": 52,
    "indy_concat": 53,
    "switch_expressions": 60,
    "pattern_matching": 60,
    "sealed": 61,
}
PREVIEW_MINOR = 65535


def java_release(major) -> Column:
    """Release number, null before the first one."""
    major = _col(major)
    return F.when(major >= 45, (major - 44).cast("int"))


def release_label(major, minor=None) -> Column:
    """``1.x`` up to release 4 and the plain number from 5 on."""
    rel = java_release(major)
    return F.when(rel < 5, F.concat(F.lit("1."), rel.cast("string"))).otherwise(rel.cast("string"))


def release_features(major, minor=None) -> Column:
    """Struct with one boolean per language feature; sealed types also count one release early in preview."""
    major = _col(major)
    minor = F.lit(0) if minor is None else _col(minor)
    cols = [(major >= since).alias(name) for name, since in FEATURE_SINCE.items() if name != "sealed"]
    sealed = (major >= FEATURE_SINCE["sealed"]) | ((major == 60) & (minor == PREVIEW_MINOR))
    return F.struct(*cols, sealed.alias("sealed"))
