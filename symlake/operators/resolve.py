"""Joins from references to declarations.

A name may be declared in thousands of containers and referenced millions of times, so no operator here emits
reference x declaration pairs. Results are factored: one row per reference (or per distinct reference key) that
names a candidate set, plus one table that lists each candidate set once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symlake import model as m
from symlake.functions.descriptors import descriptors_match
from symlake.functions.locators import build_locator, parse_fragment
from symlake.functions.names import _col, simple_name
from symlake.functions.patterns import scope_match
from symlake.session import Scratch


def resolve(refs: DataFrame, decls: DataFrame, key: str = "key") -> DataFrame:
    """``refs`` with the number of declaring entries and the first of them; 0 and nulls when there is none."""
    targets = (
        decls.select(key, "container", "entry_path").distinct().groupBy(key)
        .agg(F.count(F.lit(1)).alias("n_targets"), F.min(F.struct("container", "entry_path")).alias("_first"))
        .select(key, "n_targets", F.col("_first.container").alias("target_container"),
                F.col("_first.entry_path").alias("target_entry"))
    )
    return refs.join(targets, key, "left").fillna(0, ["n_targets"])


def candidate_sets(decls: DataFrame) -> DataFrame:
    """Members of every candidate set: ``(set_key, set_container, container, entry_path)``. ``set_container`` is
    the container for same-container sets and null for the set of all declarations of the key."""
    decls = decls.select("key", "container", "entry_path").distinct()
    both = F.explode(F.array(F.col("container"), F.lit(None).cast("string")))
    return decls.select(F.col("key").alias("set_key"), both.alias("set_container"), "container", "entry_path")


def resolve_same_container(refs: DataFrame, decls: DataFrame) -> DataFrame:
    """Candidates of ``refs(key, container)``: all declarations in the container of the reference if there are
    any, else all declarations.

    Adds ``scope`` (same, any, none), ``n_candidates`` and the first candidate. The set itself is in
    ``candidate_sets`` under ``(key, container)`` for scope *same* and ``(key, NULL)`` for scope *any*.
    """
    decls = decls.select("key", "container", "entry_path").distinct()
    first = F.min(F.struct("container", "entry_path"))
    local = decls.groupBy("key", "container").agg(F.count(F.lit(1)).alias("n_local"), first.alias("first_local"))
    # Built on the per-container counts, so a hot key shrinks before it is grouped again.
    world = local.groupBy("key").agg(F.sum("n_local").alias("n_all"), F.min("first_local").alias("first_all"))
    hit = refs.join(local, ["key", "container"], "left").join(world, "key", "left")
    chosen = F.coalesce("first_local", "first_all")
    return hit.select(
        *refs.columns,
        F.when(F.col("n_local").isNotNull(), "same").when(F.col("n_all").isNotNull(), "any")
        .otherwise("none").alias("scope"),
        F.coalesce("n_local", "n_all", F.lit(0)).alias("n_candidates"),
        chosen["container"].alias("first_container"), chosen["entry_path"].alias("first_entry"))


def preferred_entries(names: DataFrame, decls: DataFrame, container: str) -> DataFrame:
    """Entry to open for each of ``names(type_name, ...)`` seen from one container: its own declaration if it has
    one, else the first of all. ``decls(type_name, container, entry_path)``."""
    refs = names.withColumn("key", F.col("type_name")).withColumn("container", F.lit(container))
    found = resolve_same_container(refs, decls.select(F.col("type_name").alias("key"), "container", "entry_path"))
    return found.select(*names.columns, F.col("first_container").alias("container"),
                        F.col("first_entry").alias("entry_path"))


def dangling_refs(refs: DataFrame, decls: DataFrame, key: str = "key") -> DataFrame:
    return refs.join(decls.select(key).distinct(), key, "left_anti")


def live_refs(refs: DataFrame, decls: DataFrame, key: str = "key") -> DataFrame:
    return refs.join(decls.select(key).distinct(), key, "left_semi")


def _any_params(d: Column) -> Column:
    return d.startswith("(*")


def _wild(d: Column) -> Column:
    return d.contains("?") | d.contains("*")


def _shape(d: Column) -> Column:
    """Parameter count of a method, -1 for a field."""
    inside = F.substring_index(F.substring_index(d, ")", 1), "(", -1)
    count = F.length(F.regexp_replace(inside, r"\[*(?:L[^;]*;|[^L\[])", "."))
    return F.when(d.startswith("("), count).otherwise(F.lit(-1)).cast("string")


def _present(*keys: Column) -> Column:
    return F.explode(F.filter(F.array(*keys), lambda k: k.isNotNull()))


# Marks of the ways a reference and a declaration can meet.
_SAME, _SHAPE, _WILD_SHAPE, _ANY_METHOD, _ANY_DECL = "=", "#", "~#", "*", "~*"


def meet_refs(refs: DataFrame, descriptor: str, wild_refs: bool = True, wild_decls: bool = True) -> DataFrame:
    """``refs`` keyed by what their descriptor can meet, in column ``_meet``."""
    d = F.col(descriptor)
    if not wild_refs and not wild_decls:
        return refs.withColumn("_meet", d)
    keys = [F.when(~_wild(d), F.concat(F.lit(_SAME), d)).when(_any_params(d), _ANY_METHOD)
            .otherwise(F.concat(F.lit(_SHAPE), _shape(d)))]
    if not wild_decls:
        return refs.withColumn("_meet", F.coalesce(keys[0], F.lit("")))
    keys += [F.when(~_any_params(d), F.concat(F.lit(_WILD_SHAPE), _shape(d))),
             F.when(~_any_params(d) & d.startswith("("), _ANY_DECL)]
    return refs.select("*", _present(*keys).alias("_meet"))


def meet_decls(decls: DataFrame, descriptor: str, wild_refs: bool = True, wild_decls: bool = True) -> DataFrame:
    """``decls`` keyed by the ways they can be met, in column ``_meet``."""
    d = F.col(descriptor)
    if not wild_refs and not wild_decls:
        return decls.withColumn("_meet", d)
    plain = ~_wild(d)
    keys = [F.when(plain, F.concat(F.lit(_SAME), d))]
    if wild_refs:
        keys += [F.when(plain, F.concat(F.lit(_SHAPE), _shape(d))), F.when(d.startswith("("), _ANY_METHOD)]
    if wild_decls:
        keys += [F.when(~plain & ~_any_params(d), F.concat(F.lit(_WILD_SHAPE), _shape(d))),
                 F.when(_any_params(d), _ANY_DECL)]
    if len(keys) == 1:
        return decls.withColumn("_meet", keys[0])
    return decls.select("*", _present(*keys).alias("_meet"))


def meets(ref_desc: str, decl_desc: str) -> Column:
    """What is left to check once both sides share ``_meet``."""
    return F.when(F.col("_meet").startswith(_SAME), True).otherwise(descriptors_match(ref_desc, decl_desc))


def _kind(type_name, descriptor) -> Column:
    """Kind of a reference or declaration: its type known or not, its descriptor plain, with unknown types, or any."""
    d = F.coalesce(descriptor, F.lit(""))
    return F.concat(F.when(_col(type_name).startswith("*"), "unknown ").otherwise("known "),
                    F.when(~_wild(d), "plain").when(_any_params(d), "any").otherwise("shaped"))


_KINDS = [f"{t} {d}" for t in ("known", "unknown") for d in ("plain", "shaped", "any")]


def save_with_kinds(scratch: Scratch, df: DataFrame, step: str, type_name, descriptor) -> tuple[DataFrame, set[str], int]:
    """``df`` written to ``scratch`` and read again, with the kinds of its rows and their number, noted on the way."""
    bits = F.create_map(*[F.lit(x) for i, k in enumerate(_KINDS) for x in (k, 1 << i)])
    saved, n, seen = scratch.save_noting(df, step, {"kinds": F.bit_or(F.try_element_at(bits, _kind(type_name, descriptor)))})
    return saved, {k for i, k in enumerate(_KINDS) if (seen["kinds"] or 0) >> i & 1}, n


def _meeting(ref_kinds: set[str], decl_kinds: set[str], wild_decls: bool) -> list[tuple[str, str]]:
    """The marks of type and descriptor under which rows of these kinds can meet. Rows of two kinds meet under one pair
    of marks only, so no pair of rows is found twice."""
    out = set()
    for rt, rd in (k.split() for k in ref_kinds):
        for dt, dd in (k.split() for k in decl_kinds):
            t = _BY_DECL if wild_decls and dt == "unknown" else _FULL if rt == "known" else _BY_REF
            if rd == "any":
                d = _ANY_METHOD
            elif dd == "plain":
                d = _SAME if rd == "plain" else _SHAPE
            else:
                d = _WILD_SHAPE if dd == "shaped" else _ANY_DECL
            if wild_decls or d not in (_WILD_SHAPE, _ANY_DECL):
                out.add((t, d))
    return sorted(out)


_FULL, _BY_REF, _BY_DECL = "=", "*", "~"


def wildcard_join(refs: DataFrame, decls: DataFrame, ref_kinds: set[str], decl_kinds: set[str], ref_type: str, decl_type: str,
                  ref_name: str, decl_name: str, ref_desc: str, decl_desc: str, wild_decls: bool = True, near: tuple[str, ...] = ()) -> DataFrame:
    """Inner join where type, name and descriptor match, wildcards on both sides, as one equi-join.

    A full name meets the same full name, an unknown reference every full name with its simple name, and a declaration
    without its package (``*/T``) whatever has its simple name. An exact descriptor meets the same descriptor, one with
    unknown types those of its shape, "any parameters" every method of the name. Each row is keyed by what it can meet
    among the kinds the other side holds, so marks that nothing answers to are never shuffled. The key is a hash;
    type, name and descriptor are compared afterwards. ``near`` names columns that are equal wherever rows can meet; both
    sides dealt by them are keyed and joined where they are.
    """
    marks = _meeting(ref_kinds, decl_kinds, wild_decls)
    empty = F.lit("")

    def keyed(df: DataFrame, name: str, types: dict, descs: dict) -> DataFrame:
        keys = []
        for t, d in marks:
            (t_if, t_key), (d_if, d_key) = types[t], descs[d]
            keys.append(F.when(t_if & d_if, F.struct(F.lit(t + d).alias("mark"), F.xxhash64(t_key, F.col(name), d_key).alias("key"))))
        none = F.struct(F.lit("").alias("mark"), F.lit(0).cast("bigint").alias("key"))
        found = _present(*keys) if keys else F.explode(F.filter(F.array(none), lambda k: F.lit(False)))
        return df.select("*", found.alias("_m")).select(*df.columns, F.col("_m.mark").alias("_mark"), F.col("_m.key").alias("_key"))

    rt, rd, dt, dd = F.col(ref_type), F.col(ref_desc), F.col(decl_type), F.col(decl_desc)
    always, unknown_ref = F.lit(True), rt.startswith("*")
    full_decl = ~dt.startswith("*") if wild_decls else dt.isNotNull()
    left = keyed(refs, ref_name, {
        _FULL: (~unknown_ref, rt), _BY_REF: (unknown_ref, simple_name(ref_type)), _BY_DECL: (always, simple_name(ref_type))}, {
        _SAME: (~_wild(rd), rd), _SHAPE: (_wild(rd) & ~_any_params(rd), _shape(rd)), _ANY_METHOD: (_any_params(rd), empty),
        _WILD_SHAPE: (~_any_params(rd), _shape(rd)), _ANY_DECL: (~_any_params(rd) & rd.startswith("("), empty)})
    right = keyed(decls, decl_name, {
        _FULL: (full_decl, dt), _BY_REF: (full_decl, simple_name(decl_type)), _BY_DECL: (dt.startswith("*"), simple_name(decl_type))}, {
        _SAME: (~_wild(dd), dd), _SHAPE: (~_wild(dd), _shape(dd)), _ANY_METHOD: (dd.startswith("("), empty),
        _WILD_SHAPE: (_wild(dd) & ~_any_params(dd), _shape(dd)), _ANY_DECL: (_any_params(dd), empty)})
    met = F.substring("_mark", 2, 2)
    same_desc = F.when(met == _SAME, rd == dd)
    if any(d in (_SHAPE, _WILD_SHAPE) for _, d in marks):
        same_desc = same_desc.when(met.isin(_SHAPE, _WILD_SHAPE), descriptors_match(ref_desc, decl_desc))
    same_type = F.when(F.col("_mark").startswith(_FULL), rt == dt)
    if any(t != _FULL for t, _ in marks):
        loose = scope_match(rt, decl_type)
        if wild_decls:
            loose = loose | (dt.startswith("*") & scope_match(dt, ref_type))
        same_type = same_type.otherwise(loose)
    # Compared in one expression, so that rows are sorted by numbers and not by the strings behind them.
    return left.join(right, [*near, "_key", "_mark"]).filter(
        F.when(F.col(ref_name) == F.col(decl_name), same_type & same_desc.otherwise(True))).drop("_mark", "_key")


def member_match(refs: DataFrame, members: DataFrame, wild_refs: bool = True, wild_decls: bool = True) -> DataFrame:
    """Distinct ``(type_name, name, descriptor)`` references with the declared descriptors they may mean.

    Both sides are made distinct first, so what is joined are patterns and overloads, however often a member is
    referenced or copied. Wildcards may stand on both sides. A type ``*/T`` is looked up through its simple name
    and then checked in full. Exact references (``wild_refs=False``) are a plain equi-join.
    """
    wanted = refs.select("type_name", "name", "descriptor").distinct()
    have = members.select(F.col("type_name").alias("found_type"), "name",
                          F.col("descriptor").alias("found_descriptor")).distinct()
    if not wild_refs:
        left = meet_refs(wanted.withColumn("_type", F.col("type_name")), "descriptor", wild_refs, wild_decls)
        right = meet_decls(have.withColumn("_type", F.col("found_type")), "found_descriptor", wild_refs, wild_decls)
        both = left.join(right, ["_type", "name", "_meet"])
        if wild_decls:
            both = both.filter(meets("descriptor", "found_descriptor"))
        return both.select("type_name", "name", "descriptor", "found_type", "found_descriptor")
    scratch = Scratch(refs.sparkSession, "member-match")
    wanted, ref_kinds, _ = save_with_kinds(scratch, wanted.withColumn("_type", F.coalesce("type_name", F.lit(""))), "refs", "_type", "descriptor")
    have, decl_kinds, _ = save_with_kinds(scratch, have.withColumnRenamed("name", "_name"), "declared", "found_type", "found_descriptor")
    return wildcard_join(wanted, have, ref_kinds, decl_kinds, "_type", "found_type", "name", "_name", "descriptor", "found_descriptor",
                         wild_decls).select("type_name", "name", "descriptor", "found_type", "found_descriptor")


# Rows that one task is meant to join, and the groups that rows are counted in to find out where more would come together.
TASK_ROWS, _GROUPS = 500_000, 1 << 16


def _group(near: str) -> Column:
    return F.pmod(F.col(near), F.lit(_GROUPS))


def crowded_groups(near: str, n: int, *sides: DataFrame) -> list[int]:
    """Groups of ``near`` with more of the ``n`` rows of all sides than one task is meant to join."""
    if n <= TASK_ROWS:
        return []
    counts = reduce(DataFrame.unionByName, [s.select(_group(near).alias("group")) for s in sides]).groupBy("group").count()
    return [r["group"] for r in counts.filter(F.col("count") > max(TASK_ROWS, 10 * n // _GROUPS)).collect()]


def match_fragment(declarations: DataFrame, fragments: DataFrame, wild_decls: bool = True) -> DataFrame:
    """``fragments(fragment)`` against ``declarations(type_name, name, descriptor, start, end)``.

    A bare type finds type declarations, ``*/T`` in any package; members compare descriptors with wildcards; a
    static initializer that is not declared falls back to its type.

    Whatever meets has the same simple type name. Rows are dealt by it once, as they came, and made distinct, keyed and
    joined where they are; rows of a type that came side by side stay so. Simple names with more rows than one task is
    meant to join are keyed first and dealt by all that has to be equal.
    """
    # A bare type is a member without name and descriptor, so one join serves types, fields and methods.
    none = F.lit("")
    scratch = Scratch(declarations.sparkSession, "fragments")
    columns = ["type_name", "name", "descriptor", "start", "end"]
    parsed = parse_fragment("fragment")
    f_columns = {"f_type": parsed["type"], "f_name": F.coalesce(parsed["name"], none), "f_desc": F.coalesce(parsed["descriptor"], none)}
    d_columns = {"_name": F.coalesce("name", none), "_desc": F.when(F.col("name").isNull(), none).otherwise(F.coalesce("descriptor", none))}
    f, ref_kinds, n_refs = save_with_kinds(
        scratch, fragments.select("fragment").filter(parsed["type"].isNotNull()), "fragments", f_columns["f_type"], f_columns["f_desc"])
    d, decl_kinds, n_decls = save_with_kinds(scratch, declarations.select(*columns), "declarations", "type_name", d_columns["_desc"])
    f = f.withColumn("_near", F.xxhash64(simple_name(f_columns["f_type"])))
    d = d.withColumn("_near", F.xxhash64(simple_name("type_name")))

    def matched(f: DataFrame, d: DataFrame, *near: str) -> DataFrame:
        f, d = f.withColumns(f_columns), d.withColumns(d_columns)

        def found(refs: DataFrame, decls: DataFrame) -> DataFrame:
            return wildcard_join(refs, decls, ref_kinds, decl_kinds, "f_type", "type_name", "f_name", "_name", "f_desc", "_desc", wild_decls, near)

        # A static initializer that is not declared is found at its type, so types stand in for it. Only initializers are
        # looked at together.
        initializer = "<clinit>"
        asked = f.filter(F.col("fragment").endswith(f"-{initializer}-()V") & (F.col("f_name") == initializer))
        own = found(asked, d.filter(F.col("_name") == initializer)).filter(F.col("type_name") == F.col("f_type")).select(*near, "fragment").distinct()
        types = d.filter(F.col("name").isNull()).select(*near, *columns, F.col("type_name").alias("f_type"))
        stand_in = asked.select(*near, "fragment", "f_type").join(types, [*near, "f_type"]).join(own, [*near, "fragment"], "left_anti")
        return found(f, d).select("fragment", *columns).unionByName(stand_in.select("fragment", *columns))

    n = n_refs + n_decls
    tasks = max(f.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS))

    def dealt(df: DataFrame) -> DataFrame:
        task = F.coalesce(F.pmod(F.col("_near"), F.lit(tasks)).cast("int"), F.lit(0))  # never null, so not checked for it
        return df.withColumn("_task", task).repartitionById(tasks, "_task")

    crowded = crowded_groups("_near", n, f, d)
    if not crowded:
        return matched(dealt(f).distinct(), dealt(d), "_near", "_task")
    apart = _group("_near").isin(crowded)
    return matched(dealt(f.filter(~apart)).distinct(), dealt(d.filter(~apart)), "_near", "_task").unionByName(
        matched(f.filter(apart).drop("_near").distinct(), d.filter(apart).drop("_near")))


def core_types(types: DataFrame, package: str = "java/lang") -> DataFrame:
    """``(name)`` of all top-level types of the core package in the corpus: what a name means without an import."""
    head = package + "/"
    return types.filter(F.col("type_name").startswith(head)).select(
        F.substring(F.col("type_name"), F.lit(len(head) + 1), F.length("type_name")).alias("name")).filter(~F.col("name").rlike("[/$]")).distinct()


def resolve_cascade(names: DataFrame, imports: DataFrame, declared: DataFrame,
                    core: DataFrame | None = None) -> DataFrame:
    """Resolve ``names(container, entry_path, package, name)`` to internal type names.

    Order: import of the entry, type of the same package in the container, type of the root package, core
    package, else ``*/name``. ``imports(container, entry_path, name, type_name)`` keeps one target per name and
    ``declared(container, package, name)`` lists types, ``core(name)`` those of the core package (see ``core_types``). Every right side is unique on its join key, so no step
    multiplies rows. Names that are already qualified pass through.
    """
    imp = imports.groupBy("container", "entry_path", "name").agg(F.max("type_name").alias("imported"))
    own = declared.filter(F.col("package") != "").select("container", "package", "name").distinct() \
        .withColumn("in_package", F.lit(True))
    root = declared.filter(F.col("package") == "").select("container", "name").distinct() \
        .withColumn("in_root", F.lit(True))
    if core is None:
        core = names.select("name").limit(0)
    joined = (
        names.join(imp, ["container", "entry_path", "name"], "left")
        .join(own, ["container", "package", "name"], "left")
        .join(root, ["container", "name"], "left")
        .join(core.select("name").distinct().withColumn("in_core", F.lit(True)), "name", "left")
    )
    qualified = F.col("name").contains(".") | F.col("name").contains("/")
    cases: list[tuple[Column, str, Column]] = [
        (qualified, "qualified", F.translate("name", ".", "/")),
        (F.col("imported").isNotNull(), "import", F.col("imported")),
        (F.col("in_package").isNotNull(), "package", F.concat_ws("/", "package", "name")),
        (F.col("in_root").isNotNull(), "root", F.col("name")),
        (F.col("in_core").isNotNull(), "core", F.concat(F.lit("java/lang/"), "name")),
    ]
    by = F.lit("unknown")
    target = F.concat(F.lit("*/"), "name")
    for cond, label, value in reversed(cases):
        by = F.when(cond, label).otherwise(by)
        target = F.when(cond, value).otherwise(target)
    return joined.select(*names.columns, target.alias("type_name"), by.alias("resolved_by"))


# Index that declares each kind of reference in a module description.
INDEX_OF_KIND = {
    "type": m.TYPE_DECLARATIONS, "package": m.PACKAGE_DECLARATIONS, "module": m.MODULE_DECLARATIONS,
}


def resolve_by_kind(refs: DataFrame, postings: DataFrame) -> DataFrame:
    """``refs(kind, key)`` resolved in the index of their kind, in one join on ``(index_name, key)``."""
    index = F.col("kind")
    mapped = F.create_map(*[F.lit(x) for kv in INDEX_OF_KIND.items() for x in kv])
    targets = (
        postings.filter(F.col("index_name").isin(list(INDEX_OF_KIND.values())))
        .select("index_name", "key", "container", "entry_path").distinct().groupBy("index_name", "key")
        .agg(F.count(F.lit(1)).alias("n_targets"), F.min(F.struct("container", "entry_path")).alias("_first"))
    )
    return (
        refs.withColumn("index_name", F.try_element_at(mapped, index)).join(targets, ["index_name", "key"], "left")
        .select(*refs.columns, F.coalesce("n_targets", F.lit(0)).alias("n_targets"),
                F.col("_first.container").alias("target_container"),
                F.col("_first.entry_path").alias("target_entry"))
    )


def source_path(class_path: Column) -> Column:
    """Source file of a class entry: nested types live in the file of their outermost type."""
    stem = F.regexp_replace(class_path, r"\.class$", "")
    folder = F.substring(stem, F.lit(1), F.length(stem) - F.length(simple_name(stem)))
    return F.concat(folder, F.substring_index(simple_name(stem), "$", 1), F.lit(".java"))


def source_coverage(classes: DataFrame, sources: list[DataFrame]) -> DataFrame:
    """Source for each class entry from an ordered list of providers; the first provider that has it wins.

    A provider is ``(container, entry_path[, ...])``. Adds ``source_entry`` and ``provider`` (its position).
    """
    tagged = [s.select("container", F.col("entry_path").alias("source_entry"), F.lit(i).alias("provider"))
              for i, s in enumerate(sources)]
    best = reduce(DataFrame.unionByName, tagged).groupBy("container", "source_entry").agg(
        F.min("provider").alias("provider"))
    want = classes.withColumn("source_entry", source_path(F.col("entry_path")))
    return want.join(best, ["container", "source_entry"], "left").select(
        *classes.columns, F.when(F.col("provider").isNotNull(), F.col("source_entry")).alias("source_entry"),
        "provider")


def outer_locator(entries: DataFrame, declarations: DataFrame, query: str | None = None) -> DataFrame:
    """Locator of a type entry: the entry of its outer type in the same container plus a fragment.

    ``entries(container, entry_path, type_name, outer_name)``; without an outer type, or without its entry, the
    own path is used.
    """
    outer = declarations.groupBy("container", F.col("type_name").alias("outer_name")).agg(
        F.min("entry_path").alias("outer_entry"))
    path = F.coalesce("outer_entry", "entry_path")
    q = None if query is None else F.lit(query)
    return entries.join(outer, ["container", "outer_name"], "left").select(
        *entries.columns, build_locator("container", path, q, "type_name").alias("locator"))


def class_root(files: DataFrame) -> DataFrame:
    """Root directory of a class file on disk: ``files(file_path, type_name)`` where the longest suffix of
    ``type_name.class`` that ends the path is cut off. Suffixes are tried inside the row."""
    wanted = F.concat("type_name", F.lit(".class"))
    parts = F.split(wanted, "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)),
                           lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    path = F.col("file_path")
    fits = F.filter(suffixes, lambda s: (path == s) | path.endswith(F.concat(F.lit("/"), s)))
    return files.select(
        *files.columns, F.get(fits, F.lit(0)).alias("inner_path"),
        F.substring(path, F.lit(1), F.length(path) - F.length(F.get(fits, F.lit(0))) - 1).alias("root_path"))


def entry_of_type(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Entry ``type_name.class`` among the siblings of a given entry: ``requests(container, parent_path,
    type_name)``; null when the directory does not hold it."""
    have = entries.filter(~F.col("is_dir")).select(
        "container", "parent_path", F.col("entry_path").alias("found_entry")).distinct()
    path = F.concat("type_name", F.lit(".class"))
    return requests.withColumn("found_entry", path).join(
        have.withColumn("_found", F.lit(True)), ["container", "parent_path", "found_entry"], "left").select(
        *requests.columns, F.when(F.col("_found"), F.col("found_entry")).alias("found_entry"))


def remove_inner(entries: DataFrame, inner_classes: DataFrame) -> DataFrame:
    """Drop entries of nested classes that a class of the container lists as inner."""
    at = F.col("listed_path") if "listed_path" in inner_classes.columns else F.concat("inner_name", F.lit(".class"))
    listed = inner_classes.select("container", at.alias("entry_path")).distinct()
    nested = F.col("entry_path").endswith(".class") & simple_name("entry_path").contains("$")
    keep = entries.filter(~nested)
    return keep.unionByName(entries.filter(nested).join(listed, ["container", "entry_path"], "left_anti"))
