"""Prefix rules and identifier checks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlake.functions.names import _col

# Default accept/reject prefixes for artifact lookups, first match decides.
DEFAULT_PREFIX_RULES = (
    "+org +com.google +com.springsource +com.sun -com +java +javax +sun +sunw +spring +springframework "
    "+springmodules +tomcat +maven +edu"
)

# Reserved words of the Java language.
JAVA_KEYWORDS = [
    "abstract", "assert", "boolean", "break", "byte", "case", "catch", "char", "class", "const", "continue",
    "default", "do", "double", "else", "enum", "extends", "false", "final", "finally", "float", "for", "goto",
    "if", "implements", "import", "instanceof", "int", "interface", "long", "native", "new", "null", "package",
    "private", "protected", "public", "return", "short", "static", "strictfp", "super", "switch",
    "synchronized", "this", "throw", "throws", "transient", "true", "try", "void", "volatile", "while",
]

# Device names that a file system may refuse as file names.
RESERVED_FILE_NAMES = (
    ["con", "prn", "aux", "nul"] + [f"com{i}" for i in range(1, 10)] + [f"lpt{i}" for i in range(1, 10)]
)
MAX_CLASS_NAME = 249

# A Java identifier without characters that compilers ignore.
IDENTIFIER = r"\A\p{javaJavaIdentifierStart}[\p{javaJavaIdentifierPart}&&[^\p{javaIdentifierIgnorable}]]*\z"


def prefix_rules(c, rules: str = DEFAULT_PREFIX_RULES) -> Column:
    """``+prefix``/``-prefix`` list on internal names; the first matching prefix decides, none rejects."""
    c = _col(c)
    verdict = None
    for rule in rules.split():
        if len(rule) < 2:
            continue
        prefix = rule[1:].replace(".", "/").rstrip("/") + "/"
        hit, keep = c.startswith(prefix), F.lit(rule[0] == "+")
        verdict = F.when(hit, keep) if verdict is None else verdict.when(hit, keep)
    return F.lit(False) if verdict is None else verdict.otherwise(False)




def only_prefixes(df: DataFrame, c: str, prefixes: list[str]) -> DataFrame:
    """Rows whose ``c`` starts with any prefix; an empty list keeps every row. Pushed down to the scan."""
    if not prefixes:
        return df
    keep = F.col(c).startswith(prefixes[0])
    for p in prefixes[1:]:
        keep = keep | F.col(c).startswith(p)
    return df.filter(keep)


def suspicious_name(c, kind) -> Column:
    """True for names that look obfuscated or illegal. ``kind`` is ``class``, ``method`` or ``field``; class
    names are simple names."""
    c, kind = _col(c), _col(kind)
    special = (kind == "method") & c.isin("<init>", "<clinit>")
    on_disk = (kind == "class") & (F.lower(c).isin(RESERVED_FILE_NAMES) | (F.length(c) > MAX_CLASS_NAME))
    return (c.isNull() | (F.length(c) <= 2) | ~(special | c.rlike(IDENTIFIER))
            | c.isin(JAVA_KEYWORDS) | on_disk)
