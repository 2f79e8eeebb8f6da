"""Access flag masks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlake.functions.names import _col

# Access flag bits of the class file format.
PUBLIC = 0x0001
PRIVATE = 0x0002
PROTECTED = 0x0004
STATIC = 0x0008
FINAL = 0x0010
BRIDGE = 0x0040
VARARGS = 0x0080
INTERFACE = 0x0200
ABSTRACT = 0x0400
SYNTHETIC = 0x1000
ANNOTATION = 0x2000
ENUM = 0x4000


def has_flag(c, mask: int) -> Column:
    return _col(c).bitwiseAND(F.lit(mask)) != 0


def decode_flags(c) -> Column:
    """Struct ``visibility, is_static, is_final, is_abstract, kind``."""
    return F.struct(
        F.when(has_flag(c, PUBLIC), "public")
        .when(has_flag(c, PROTECTED), "protected")
        .when(has_flag(c, PRIVATE), "private")
        .otherwise("package").alias("visibility"),
        has_flag(c, STATIC).alias("is_static"),
        has_flag(c, FINAL).alias("is_final"),
        has_flag(c, ABSTRACT).alias("is_abstract"),
        F.when(has_flag(c, ANNOTATION), "annotation")
        .when(has_flag(c, INTERFACE), "interface")
        .when(has_flag(c, ENUM), "enum")
        .otherwise("class").alias("kind"),
    )


def is_visible_field(c) -> Column:
    return ~has_flag(c, SYNTHETIC | ENUM)


def is_visible_method(c) -> Column:
    return ~has_flag(c, SYNTHETIC | ENUM | BRIDGE)


def is_visible_inner(c) -> Column:
    return ~has_flag(c, SYNTHETIC | BRIDGE)


def visible_members(members: DataFrame) -> DataFrame:
    """Drop compiler-made members; ``kind`` is ``field``, ``method`` or ``type``."""
    return members.filter(
        F.when(F.col("kind") == "field", is_visible_field("flags"))
        .when(F.col("kind") == "method", is_visible_method("flags"))
        .otherwise(is_visible_inner("flags")))
