"""Type and package names. Internal form separates packages with ``/`` and inner types with ``$``."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def simple_name(c) -> Column:
    """Text after the last ``/``."""
    return F.substring_index(_col(c), "/", -1)


def innermost_name(c) -> Column:
    """Text after the later of the last ``/`` and the last ``$``."""
    return F.substring_index(simple_name(c), "$", -1)


def package_name(c) -> Column:
    """Internal package (``a/b``), empty for the default package."""
    c = _col(c)
    return F.substring(c, F.lit(1), F.length(c) - F.length(simple_name(c)) - 1)


def display_package(c) -> Column:
    """Dotted package, empty for the default package."""
    return F.translate(package_name(c), "/", ".")


def to_dotted(c) -> Column:
    return F.translate(_col(c), "/", ".")


def to_internal(c) -> Column:
    return F.translate(_col(c), ".", "/")


def package_of_source(c) -> Column:
    """Package declared by Java source text, empty when there is none."""
    return F.regexp_extract(_col(c), r"(?m)^\s*package\s+([\w$.]+)\s*;", 1)


def qualified_name(package, display_type, member=None) -> Column:
    """``package.Type[.member]``; the dot after an empty package is left out and a null member is skipped."""
    parts = [F.when(_col(package) != "", _col(package)), _col(display_type)]
    if member is not None:
        parts.append(_col(member))
    return F.concat_ws(".", *parts)
