"""Class symbol ingest.

``class_symbols`` reads the header, constant pool and member tables of each class file inside the scan task and
emits a narrow tagged table; everything that looks across classes (distinct postings, hierarchies, counts) is
left to Spark. Code, debug and frame data are skipped.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlake import model as m
from symlake.operators.postings import build_postings
from symlake.session import Scratch, ship_package

# Constant pool tags of the class file format and the size of their payload.
UTF8, INTEGER, FLOAT, LONG, DOUBLE, CLASS, STRING = 1, 3, 4, 5, 6, 7, 8
FIELDREF, METHODREF, INTERFACE_METHODREF, NAME_AND_TYPE = 9, 10, 11, 12
METHOD_HANDLE, METHOD_TYPE, DYNAMIC, INVOKE_DYNAMIC, MODULE, PACKAGE = 15, 16, 17, 18, 19, 20
PAYLOAD = {
    INTEGER: 4, FLOAT: 4, LONG: 8, DOUBLE: 8, CLASS: 2, STRING: 2, FIELDREF: 4, METHODREF: 4,
    INTERFACE_METHODREF: 4, NAME_AND_TYPE: 4, METHOD_HANDLE: 3, METHOD_TYPE: 2, DYNAMIC: 4, INVOKE_DYNAMIC: 4,
    MODULE: 2, PACKAGE: 2,
}

SYMBOLS = (
    "tag string, container string, entry_path string, a string, b string, c string, d string, "
    "flags int, major int, minor int"
)
_SYMBOL_COLUMNS = [f.split(" ")[0] for f in SYMBOLS.split(", ")]

# A type inside a descriptor or signature: labels of type parameters, member names after a point and type variables are
# skipped, a class type yields its name.
_SIGNATURE_TYPE = re.compile(r"[^:<;>()]+:|\.[^;<>:.]+|T[^;<>:]+;|L([^;<>:.]+)")


@dataclass
class _Reader:
    data: bytes
    at: int = 0

    def take(self, fmt: str):
        value = struct.unpack_from(">" + fmt, self.data, self.at)
        self.at += struct.calcsize(">" + fmt)
        return value[0] if len(value) == 1 else value


def modified_utf8(raw: bytes) -> str:
    """Text of a pool string: NUL as two bytes and surrogates one by one."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        text = raw.replace(b"\xc0\x80", b"\x00").decode("utf-8", "surrogatepass")
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


class _Pool:
    def __init__(self, r: _Reader):
        self.items: list = [None] * r.take("H")
        i = 1
        while i < len(self.items):
            tag = r.take("B")
            if tag == UTF8:
                n = r.take("H")
                self.items[i] = (tag, r.data[r.at:r.at + n])
                r.at += n
            else:
                size = PAYLOAD[tag]
                self.items[i] = (tag, r.data[r.at:r.at + size])
                r.at += size
            i += 2 if tag in (LONG, DOUBLE) else 1

    def text(self, i: int) -> str:
        return modified_utf8(self.items[i][1])

    def ref(self, i: int) -> str | None:
        """Text behind a class, string, module or package item."""
        return self.text(int.from_bytes(self.items[i][1][:2], "big")) if i else None

    def pair(self, i: int) -> tuple[int, int]:
        return struct.unpack(">HH", self.items[i][1])


def signature_types(signature: str) -> set[str]:
    """Class names inside a descriptor or generic signature."""
    return {t.group(1) for t in _SIGNATURE_TYPE.finditer(signature) if t.group(1)}


def _attributes(r: _Reader, pool: _Pool) -> list[tuple[str, bytes]]:
    out = []
    for _ in range(r.take("H")):
        name, size = r.take("HI")
        out.append((pool.text(name), r.data[r.at:r.at + size]))
        r.at += size
    return out


def _element_value(r: _Reader, pool: _Pool, out: set[str]) -> None:
    tag = chr(r.take("B"))
    if tag == "e":
        out.add(pool.text(r.take("HH")[0]))
    elif tag == "@":
        _annotation(r, pool, out)
    elif tag == "[":
        for _ in range(r.take("H")):
            _element_value(r, pool, out)
    else:
        r.at += 2


def _annotation(r: _Reader, pool: _Pool, out: set[str]) -> None:
    out.add(pool.text(r.take("H")))
    for _ in range(r.take("H")):
        r.at += 2
        _element_value(r, pool, out)


# Payload size behind each target kind of a type annotation (-1: table of 6-byte rows).
_TARGET_BYTES = {
    0x00: 1, 0x01: 1, 0x10: 2, 0x11: 2, 0x12: 2, 0x13: 0, 0x14: 0, 0x15: 0, 0x16: 1, 0x17: 2, 0x40: -1, 0x41: -1,
    0x42: 2, 0x43: 2, 0x44: 2, 0x45: 2, 0x46: 2, 0x47: 3, 0x48: 3, 0x49: 3, 0x4A: 3, 0x4B: 3,
}


def _annotation_types(attributes: list[tuple[str, bytes]], pool: _Pool) -> set[str]:
    out: set[str] = set()
    for name, data in attributes:
        if not name.endswith("Annotations") or not name.startswith("Runtime"):
            continue
        r = _Reader(data)
        if "Parameter" in name:
            for _ in range(r.take("B")):
                for _ in range(r.take("H")):
                    _annotation(r, pool, out)
            continue
        for _ in range(r.take("H")):
            if "Type" in name:
                size = _TARGET_BYTES[r.take("B")]
                r.at += size if size >= 0 else 6 * r.take("H")
                r.at += 2 * r.take("B")
            _annotation(r, pool, out)
    return out


def _module(data: bytes, pool: _Pool) -> tuple[str, set[str], set[str]]:
    """Name, referenced modules and referenced types of a module description."""
    r = _Reader(data)
    name = pool.ref(r.take("HHH")[0])
    modules, types = set(), set()
    for _ in range(r.take("H")):
        modules.add(pool.ref(r.take("HHH")[0]))
    for _ in range(2):  # exports, then opens
        for _ in range(r.take("H")):
            r.at += 4
            modules.update(pool.ref(r.take("H")) for _ in range(r.take("H")))
    types.update(pool.ref(r.take("H")) for _ in range(r.take("H")))
    for _ in range(r.take("H")):
        types.add(pool.ref(r.take("H")))
        types.update(pool.ref(r.take("H")) for _ in range(r.take("H")))
    return name, modules, types


def read_class(data: bytes) -> list[tuple]:
    """Symbols of one class file as ``(tag, a, b, c, d, flags, major, minor)`` rows."""
    r = _Reader(data)
    magic, minor, major = r.take("IHH")
    if magic != 0xCAFEBABE:
        raise ValueError("not a class file")
    pool = _Pool(r)
    access, this_class, super_class = r.take("HHH")
    name, super_name = pool.ref(this_class), pool.ref(super_class)
    interfaces = [pool.ref(r.take("H")) for _ in range(r.take("H"))]

    posts: set[tuple[str, str]] = set()
    described: set[str] = set()
    rows: list[tuple] = []
    for kind in ("field", "method"):
        for _ in range(r.take("H")):
            flags, n, d = r.take("HHH")
            member, descriptor = pool.text(n), pool.text(d)
            attributes = _attributes(r, pool)
            rows.append(("member", name, kind, member, descriptor, flags, None, None))
            named = dict(attributes)
            described.add(pool.text(int.from_bytes(named["Signature"], "big")) if "Signature" in named
                          else descriptor)
            described |= _annotation_types(attributes, pool)
            if kind == "field":
                posts.add((m.FIELD_DECLARATIONS, member))
            elif member == "<init>":
                posts.add((m.CONSTRUCTOR_DECLARATIONS, name))
            elif member != "<clinit>":
                posts.add((m.METHOD_DECLARATIONS, member))
            if "Exceptions" in named:
                e = _Reader(named["Exceptions"])
                posts.update((m.TYPE_REFERENCES, pool.ref(e.take("H"))) for _ in range(e.take("H")))
    attributes = _attributes(r, pool)
    named = dict(attributes)
    described |= _annotation_types(attributes, pool)

    outer = inner_name = None
    inner_flags = access
    if "InnerClasses" in named:
        e = _Reader(named["InnerClasses"])
        for _ in range(e.take("H")):
            inner, out, label, flags = e.take("HHHH")
            inner_type, outer_type = pool.ref(inner), pool.ref(out)
            simple = pool.text(label) if label else None
            rows.append(("inner", inner_type, outer_type, simple, name, flags, None, None))
            if inner_type == name:
                outer, inner_name, inner_flags = outer_type, simple, flags

    if "Module" in named:
        module, modules, types = _module(named["Module"], pool)
        posts.add((m.MODULE_DECLARATIONS, module))
        posts.update((m.MODULE_REFERENCES, x) for x in modules)
        posts.update((m.TYPE_REFERENCES, x) for x in types)
        if "ModuleMainClass" in named:
            posts.add((m.TYPE_REFERENCES, pool.ref(int.from_bytes(named["ModuleMainClass"], "big"))))
        return [("post", index, key, None, None, None, None, None) for index, key in posts]

    posts.add((m.TYPE_DECLARATIONS, name))
    for item in pool.items:
        if item is None:
            continue
        tag, raw = item
        if tag == CLASS:
            ref = pool.text(int.from_bytes(raw, "big"))
            if ref.startswith("["):
                described.add(ref)
            else:
                posts.add((m.TYPE_REFERENCES, ref))
        elif tag == STRING:
            posts.add((m.STRINGS, pool.text(int.from_bytes(raw, "big"))))
        elif tag in (FIELDREF, METHODREF, INTERFACE_METHODREF):
            owner, sig = struct.unpack(">HH", raw)
            member = pool.text(pool.pair(sig)[0])
            if tag == FIELDREF:
                posts.add((m.FIELD_REFERENCES, member))
            elif member == "<init>":
                posts.add((m.CONSTRUCTOR_REFERENCES, pool.ref(owner)))
            else:
                posts.add((m.METHOD_REFERENCES, member))
    for text in described:
        posts.update((m.TYPE_REFERENCES, t) for t in signature_types(text))

    rows += [("post", index, key, None, None, None, None, None) for index, key in posts]
    rows.append(("type", name, super_name, outer, inner_name, inner_flags, major, minor))
    if super_name:
        rows.append(("super", name, super_name, "class", None, None, None, None))
    rows += [("super", name, i, "interface", None, None, None, None) for i in interfaces]
    return rows


#: Tags of symbols: post, type, member, super, inner, error.
N_TAGS = 6


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for container, path, content in zip(batch["container"], batch["entry_path"], batch["content"]):
            try:
                rows += [(t[0], container, path, *t[1:]) for t in read_class(bytes(content))]
            except Exception as e:
                rows.append(("error", container, path, f"{type(e).__name__}: {e}", None, None, None, None, None, None))
            if len(rows) > 50_000:
                yield _frame(rows)
                rows = []
        if rows:
            yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_SYMBOL_COLUMNS)
    return out.astype({c: "Int32" for c in ("flags", "major", "minor")})


def class_symbols(entries: DataFrame) -> DataFrame:
    """Tagged symbols of all class entries: post, type, member, super, inner, and error for unreadable files."""
    classes = entries.filter(~F.col("is_dir") & F.col("entry_path").endswith(".class") & F.col("content").isNotNull())
    ship_package(entries.sparkSession)
    # A class file becomes many rows: tasks are cut by bytes, so none grows with the input.
    return classes.select("container", "entry_path", "content").hint("rebalance").mapInPandas(_parse, SYMBOLS)


def _write_by_tag(symbols: DataFrame, target: str) -> None:
    """Store ``symbols`` by tag with a writer open for each of the few tags, so that no task sorts all its rows first."""
    conf, key = symbols.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(key)
    conf.set(key, str(max(int(before), 2 * N_TAGS)))
    try:
        symbols.write.mode("overwrite").partitionBy("tag").parquet(target)
    finally:
        conf.set(key, before)


def ingest_classes(entries: DataFrame, path: str | None = None) -> dict[str, DataFrame]:
    """Parse once, store the tagged rows by tag, and return ``postings, types, members, supertypes,
    inner_classes, errors`` as views that read only their own partition."""
    target = path or Scratch(entries.sparkSession, "classes").path("symbols")
    _write_by_tag(class_symbols(entries), target)
    full = entries.sparkSession.read.schema(SYMBOLS).parquet(target)

    def part(tag: str) -> DataFrame:
        return full.filter(F.col("tag") == tag)

    prefix = F.substring("entry_path", F.lit(1), F.length("entry_path") - F.length("d") - 6)
    return {
        "postings": build_postings(part("post").select(
            F.col("a").alias("index_name"), F.col("b").alias("key"), "container", "entry_path")),
        "types": part("type").select(
            "container", "entry_path", F.col("a").alias("type_name"), F.col("b").alias("super_name"),
            F.col("c").alias("outer_name"), F.col("d").alias("inner_name"), "flags", "major", "minor"),
        "members": part("member").select(
            "container", "entry_path", F.col("a").alias("type_name"), F.col("b").alias("kind"),
            F.col("c").alias("name"), F.col("d").alias("descriptor"), "flags"),
        "supertypes": part("super").select(
            "container", F.col("a").alias("type_name"), F.col("b").alias("super_name"), F.col("c").alias("kind")),
        "inner_classes": part("inner").select(
            "container", "entry_path", F.col("a").alias("inner_name"), F.col("b").alias("outer_name"),
            F.col("c").alias("simple"), "flags", F.concat(prefix, "a", F.lit(".class")).alias("listed_path")),
        "errors": part("error").select("container", "entry_path", F.col("a").alias("error")),
    }
