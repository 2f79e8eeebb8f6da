"""Closures over parent and super-type edges.

Three kernels, none with a depth limit:

* ``tops`` for edges with one parent per node when only the end of each chain matters: pointer jumping, one row per
  node and round, as many rounds as the depth has binary digits.
* ``chain_closure`` for all ancestors over such edges; it doubles the reach each round.
* ``graph_closure`` for several parents per node, level by level from given seeds until nothing new is found.

Each round is written to the scratch folder (see ``session.Scratch``); the row count comes with the write, so
nothing but that count reaches the driver. Joins put the fast-growing side left, where adaptive execution can
split a popular ancestor. Cycles end: jumping stops when the reach exceeds the number of nodes, and what still moves
then leads into a cycle; level by level, a node found before is not followed again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlake.functions.descriptors import descriptors_match
from symlake.functions.flags import INTERFACE, has_flag
from symlake.functions.names import simple_name
from symlake.operators.resolve import meet_decls, meet_refs
from symlake.session import Scratch


def _one_parent(edges: DataFrame) -> DataFrame:
    """Edges ``(src, dst)`` without self-links; of several ``dst`` the smallest counts."""
    return edges.filter(F.col("src") != F.col("dst")).groupBy("src").agg(F.min("dst").alias("dst"))


def tops(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``(src, top, depth, cyclic)`` for edges ``(src, dst)``: the end of each node's chain. A node whose chain leads
    into a cycle has none: ``cyclic`` is true, ``top`` and ``depth`` are null."""
    return jump_tables(edges, scratch or Scratch(edges.sparkSession, "tops"))[0]


def jump_tables(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """What ``tops`` gives, and the written tables it comes from: table ``k`` holds for every ``src`` the ``top`` that is
    2**k steps above, or the end of its chain if that is nearer, and the ``depth`` of that step."""
    now, n = scratch.save(_one_parent(edges).select("src", F.col("dst").alias("top"), F.lit(1).cast("bigint").alias("depth"),
                                                    F.lit(True).alias("moves")), "jump-0")
    reach, k, tables = 1, 0, [now]
    while n and reach <= 2 * n:
        up = now.select(F.col("src").alias("via"), F.col("top").alias("over"), F.col("depth").alias("more"))
        step = now.join(up, now["top"] == up["via"], "left").select(
            "src", F.coalesce("over", "top").alias("top"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.col("over").isNotNull().alias("moves"))
        k, reach = k + 1, 2 * reach
        now, _ = scratch.save(step, f"jump-{k}")
        tables.append(now)
        if now.filter("moves").isEmpty():
            break
    none = F.col("moves") & F.lit(k > 0)
    ends = now.select("src", F.when(~none, F.col("top")).alias("top"), F.when(~none, F.col("depth")).alias("depth"), none.alias("cyclic"))
    return ends, tables


def chain_closure(edges: DataFrame) -> DataFrame:
    """All ``(src, dst, depth)`` above each node for edges ``(src, dst)``; of several ``dst`` the smallest counts.

    A node is never its own ancestor and each pair keeps its smallest depth. Chains that lead into a cycle, if there
    are any, are followed level by level.
    """
    scratch = Scratch(edges.sparkSession, "chain")
    single, _ = scratch.save(_one_parent(edges), "edges")
    ends, _ = scratch.save(tops(single, scratch), "ends")
    looped = ends.filter("cyclic").select("src")
    straight = single.join(looped, "src", "left_anti")
    reach, steps = 1, ["reach-1"]
    jumps, n = scratch.save(straight.withColumn("depth", F.lit(1)), steps[0])
    while n:
        up = scratch.read(*steps).select(
            F.col("src").alias("via"), F.col("dst").alias("top"), F.col("depth").alias("more"))
        step = (
            jumps.join(up, jumps["dst"] == up["via"])
            .select("src", F.col("top").alias("dst"), (F.col("more") + reach).alias("depth"))
        )
        reach *= 2
        level, n = scratch.save(step, f"reach-{reach}")
        steps.append(f"reach-{reach}")
        jumps = level.filter(F.col("depth") == reach)
    out = scratch.read(*steps)
    if looped.isEmpty():
        return out
    return out.unionByName(graph_closure(single, looped.withColumnRenamed("src", "node")))


def graph_closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(src, dst, depth)`` reachable from ``seeds(node)`` over ``edges(src, dst)``, smallest depth per pair.

    Pairs found before are dropped at the levels 2, 4, 8 and so on only, so what was found is read again a few times
    however deep the graph is; in between a level holds each pair once at most."""
    scratch = Scratch(edges.sparkSession, "graph")
    edges, _ = scratch.save(edges.select("src", "dst").filter(F.col("src") != F.col("dst")).distinct(), "edges")
    hop = edges.select(F.col("src").alias("via"), F.col("dst").alias("next"))
    frontier = seeds.select(F.col("node").alias("src"), F.col("node").alias("dst")).distinct()
    steps: list[str] = []
    n, depth = 1, 0
    while n:
        depth += 1
        step = (
            frontier.join(hop, frontier["dst"] == hop["via"])
            .select("src", F.col("next").alias("dst")).filter(F.col("src") != F.col("dst")).distinct()
        )
        if steps and _doubled(depth):
            step = step.join(scratch.read(*steps).select("src", "dst"), ["src", "dst"], "left_anti")
        level, n = scratch.save(step.withColumn("depth", F.lit(depth)), f"level-{depth}")
        steps.append(f"level-{depth}")
        frontier = level.select("src", "dst")
    return scratch.read(*steps).groupBy("src", "dst").agg(F.min("depth").alias("depth"))


def _doubled(depth: int) -> bool:
    return depth & (depth - 1) == 0


def outermost(inner_outer: DataFrame) -> DataFrame:
    """``(inner_name, root_name, depth)`` for edges ``(inner_name, outer_name)``; root and depth are null for a name
    whose outer names lead into a cycle."""
    edges = inner_outer.filter(F.col("outer_name").isNotNull()).select(
        F.col("inner_name").alias("src"), F.col("outer_name").alias("dst"))
    return tops(edges).select(F.col("src").alias("inner_name"), F.col("top").alias("root_name"), F.col("depth").cast("int").alias("depth"))


def root_entries(types: DataFrame) -> DataFrame:
    """``(container, entry_path, root_entry)`` for every class entry. The chain stays inside the container and below
    the same root directory, as for the versions of a multi-release archive; a missing outermost entry falls back to
    the entry itself."""
    own_path = F.concat("type_name", F.lit(".class"))
    below = F.when(F.col("entry_path").endswith(own_path), F.substring(
        "entry_path", F.lit(1), F.length("entry_path") - F.length(own_path))).otherwise("")
    key = F.concat_ws("\u0001", "container", below, "type_name")
    outer = F.concat_ws("\u0001", "container", below, "outer_name")
    roots = outermost(types.filter(F.col("outer_name").isNotNull())
                      .select(key.alias("inner_name"), outer.alias("outer_name")))
    own = types.select("container", "entry_path", key.alias("inner_name"))
    target = types.groupBy(key.alias("root_name")).agg(F.min("entry_path").alias("root_entry"))
    return (
        own.join(roots, "inner_name", "left").join(target, "root_name", "left")
        .select("container", "entry_path", F.coalesce("root_entry", "entry_path").alias("root_entry"))
    )


def display_names(types: DataFrame) -> DataFrame:
    """``(container, type_name, display_name)``: package cut, inner names joined with dots along the chain of
    enclosing types. The chain ends at the first type that has no outer type in the container."""
    key = F.concat_ws("\u0001", "container", "type_name")
    once = types.groupBy("container", "type_name").agg(
        F.min("outer_name").alias("outer_name"), F.min("inner_name").alias("inner_name"))
    named = once.select("container", "type_name", "outer_name", "inner_name", key.alias("src"),
                         F.when(F.col("outer_name").isNotNull(),
                                F.concat_ws("\u0001", "container", "outer_name")).alias("dst"))
    chain = chain_closure(named.filter(F.col("dst").isNotNull()).select("src", "dst"))
    label = F.when(F.col("inner_name").isNotNull(), F.col("inner_name")).otherwise(simple_name("type_name"))
    labels = named.select(F.col("src").alias("dst"), label.alias("label"))
    # An outer type that is not in the container shows its own short name.
    above = chain.join(labels, "dst", "left").select(
        "src", F.struct((-F.col("depth")).alias("at"),
                        F.coalesce("label", simple_name(F.substring_index("dst", "\u0001", -1))).alias("label"))
        .alias("part"))
    lead = above.groupBy("src").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return named.join(lead, "src", "left").select(
        "container", "type_name",
        F.concat_ws(".", F.transform("parts", lambda p: p["label"]), label).alias("display_name"))


def superclass_edges(types: DataFrame) -> DataFrame:
    """``(src, dst)`` superclass edges. An interface below the root class has none, and a type found in several
    containers counts once, through its first container."""
    root_of_interface = has_flag("flags", INTERFACE) & (F.col("super_name") == "java/lang/Object")
    usable = types.filter(F.col("super_name").isNotNull() & ~root_of_interface)
    return usable.groupBy(F.col("type_name").alias("src")).agg(
        F.min_by("super_name", F.struct("container", "super_name")).alias("dst"))


def ancestors(types: DataFrame) -> DataFrame:
    """``(type_name, ancestor, depth, in_corpus)`` up to the first type outside the corpus."""
    chain = chain_closure(superclass_edges(types))
    known = types.select(F.col("type_name").alias("dst"), F.lit(True).alias("known")).distinct()
    return chain.join(known, "dst", "left").select(
        F.col("src").alias("type_name"), F.col("dst").alias("ancestor"), "depth",
        F.coalesce("known", F.lit(False)).alias("in_corpus"))


def descendants(supertypes: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(type_name, descendant, depth)`` below ``seeds(type_name)``, over classes and interfaces."""
    edges = supertypes.select(F.col("super_name").alias("src"), F.col("type_name").alias("dst"))
    return graph_closure(edges, seeds.select(F.col("type_name").alias("node"))).select(
        F.col("src").alias("type_name"), F.col("dst").alias("descendant"), "depth")


#: Types above each ``a`` that walking up is taken to find, when ``instance_of`` chooses its direction.
ABOVE = 16


def instance_of(pairs: DataFrame, supertypes: DataFrame) -> DataFrame:
    """``pairs(a, b)`` with ``is_instance``: b is a, or lies above a over superclasses and interfaces.

    Types are walked as numbers: up from every ``a``, or down from every ``b`` where all types below all of them cannot
    be more than ``ABOVE`` for each ``a``."""
    scratch = Scratch(pairs.sparkSession, "instance")
    pairs, _ = scratch.save(pairs.select("a", "b"), "pairs")
    edges, _ = scratch.save(supertypes.select(F.col("type_name").alias("src"), F.col("super_name").alias("dst")).filter(
        F.col("src") != F.col("dst")).distinct(), "edges")
    names, n_types = scratch.save(edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct().withColumn(
        "id", F.monotonically_increasing_id()), "numbers")
    number = lambda df, c: df.select(F.col("name").alias(c), F.col("id").alias(f"{c}_id"))
    up = edges.join(number(names, "src"), "src").join(number(names, "dst"), "dst").select(
        F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))
    # Of a side with few types only those are joined, so pairs that crowd on them stay where they are.
    side = lambda c: scratch.save(names.join(pairs.select(F.col(c).alias("name")).distinct(), "name", "left_semi"), c)
    (a, n_a), (b, n_b) = side("a"), side("b")
    if n_b * n_types <= ABOVE * n_a:
        found = graph_closure(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")), b.select(F.col("id").alias("node")))
        hit = found.select(F.col("src").alias("b_id"), F.col("dst").alias("a_id"), F.lit(True).alias("above"))
    else:
        found = graph_closure(up, a.select(F.col("id").alias("node")))
        hit = found.select(F.col("src").alias("a_id"), F.col("dst").alias("b_id"), F.lit(True).alias("above"))
    return pairs.join(number(b, "b"), "b", "left").join(number(a, "a"), "a", "left").join(hit, ["a_id", "b_id"], "left").select(
        "a", "b", ((F.col("a") == F.col("b")) | F.coalesce("above", F.lit(False))).alias("is_instance"))


def first_common_super(pairs: DataFrame, types: DataFrame) -> DataFrame:
    """``pairs(a, b)`` with the nearest shared type of the two superclass chains, themselves included; null where the
    chains share none or a side is null.

    Where no chain is longer than ``LINE`` and none leads into a cycle, each type carries its whole chain in numbers and a
    pair is moved three times: to the chain of either side and to the name of the first number both hold.

    Else binary lifting: the jump tables say how deep both sides lie and where their chains end. Chains with different ends
    share nothing. Otherwise the deeper side is lifted to the depth of the other one, then both climb by falling powers
    of two for as long as they stay apart, and the type above them is the answer: one row per pair and step, no chain is
    ever listed. Only types whose chains lead into a cycle are followed type by type (``_common_on_cycles``)."""
    scratch = Scratch(types.sparkSession, "common")
    edges, _ = scratch.save(superclass_edges(types), "edges")
    ends, tables = jump_tables(edges, scratch)
    height, loop = ends.agg(F.max("depth"), F.max("cyclic")).first()
    if not loop and (height or 0) <= LINE:
        return _common_on_lines(pairs, edges, height or 0, scratch)

    def side(c: str) -> DataFrame:
        return ends.select(F.col("src").alias(c), F.col("top").alias(f"{c}_end"), F.col("depth").alias(f"{c}_depth"), F.col("cyclic").alias(f"{c}_loops"))

    loops = [F.coalesce(f"{c}_loops", F.lit(False)) for c in "ab"]
    wanted = pairs.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL").distinct()
    placed, _ = scratch.save(wanted.join(side("a"), "a", "left").join(side("b"), "b", "left").select(
        "a", "b", (loops[0] & loops[1]).alias("loops"), (loops[0] | loops[1]).alias("looping"),
        (F.coalesce("a_end", "a") == F.coalesce("b_end", "b")).alias("meets"),
        (F.coalesce("a_depth", F.lit(0)) - F.coalesce("b_depth", F.lit(0))).alias("gap")), "placed")
    low, high = F.when(F.col("gap") >= 0, F.col("a")).otherwise(F.col("b")), F.when(F.col("gap") >= 0, F.col("b")).otherwise(F.col("a"))
    at = placed.filter("meets AND NOT looping").select("a", "b", low.alias("low"), high.alias("high"), F.abs("gap").alias("gap"))

    def above(k: int, c: str) -> DataFrame:
        return tables[k].select(F.col("src").alias(c), F.col("top").alias(f"{c}_up"))

    powers = range(len(tables) - 1, -1, -1)
    for k in powers:
        lifted = F.when(F.col("gap") >= 1 << k, F.col("low_up")).otherwise(F.col("low"))
        rest = F.when(F.col("gap") >= 1 << k, F.col("gap") - (1 << k)).otherwise(F.col("gap"))
        at = at.join(above(k, "low"), "low", "left").select("a", "b", lifted.alias("low"), "high", rest.alias("gap"))
    at, _ = scratch.save(at.drop("gap"), "level")
    # Pairs that met are done; the others have a type above both.
    done = at.filter("low = high").select("a", "b", F.col("low").alias("common_super"))
    at = at.filter("low != high")
    for k in powers:
        apart = F.col("low_up") != F.col("high_up")
        at = at.join(above(k, "low"), "low").join(above(k, "high"), "high").select(
            "a", "b", F.when(apart, F.col("low_up")).otherwise(F.col("low")).alias("low"),
            F.when(apart, F.col("high_up")).otherwise(F.col("high")).alias("high"))
    met = at.join(above(0, "low"), "low").select("a", "b", F.col("low_up").alias("common_super"))
    best = done.unionByName(met).unionByName(_common_on_cycles(placed.filter("loops").select("a", "b"), edges))
    return pairs.join(best, ["a", "b"], "left")


#: Longest chain that a type carries as a list.
LINE = 64


def _common_on_lines(pairs: DataFrame, edges: DataFrame, height: int, scratch: Scratch) -> DataFrame:
    """``first_common_super`` for chains of at most ``height`` steps without cycles."""
    edges = _one_parent(edges)
    names, _ = scratch.save(edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct().withColumn(
        "id", F.monotonically_increasing_id()), "numbers")
    number = lambda c: names.select(F.col("name").alias(c), F.col("id").alias(f"{c}_id"))
    line, _ = scratch.save(edges.join(number("src"), "src").join(number("dst"), "dst").select(
        F.col("src_id").alias("id"), F.array("dst_id").alias("above")), "line-1")
    reach = 1
    while reach < height:
        up = line.select(F.col("id").alias("via"), F.col("above").alias("more"))
        more = F.coalesce("more", F.array().cast("array<bigint>"))
        reach *= 2
        line, _ = scratch.save(line.join(up, F.element_at("above", -1) == F.col("via"), "left").select(
            "id", F.concat("above", more).alias("above")), f"line-{reach}")
    own = F.concat(F.array("id"), F.coalesce("above", F.array().cast("array<bigint>")))
    lines, _ = scratch.save(names.join(line, "id", "left").select("name", own.alias("line")), "lines")
    side = lambda c: lines.select(F.col("name").alias(c), F.col("line").alias(f"_{c}"))
    met = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").select(
        *pairs.columns, F.get(F.array_intersect("_a", "_b"), F.lit(0)).alias("_id"))
    found = met.join(names.select(F.col("id").alias("_id"), F.col("name").alias("_name")), "_id", "left")
    return found.select("a", "b", *[c for c in pairs.columns if c not in ("a", "b")],
                        F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("_name")).alias("common_super"))


def _common_on_cycles(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``a, b, common_super`` where both chains lead into a cycle: the shared type with the fewest steps from ``a``."""
    if pairs.isEmpty():
        return pairs.limit(0).select("a", "b", F.col("a").alias("common_super"))
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    line = nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).alias("depth")).unionByName(graph_closure(edges, nodes))
    up_a = line.select(F.col("src").alias("a"), "dst", "depth")
    up_b = line.select(F.col("src").alias("b"), "dst")
    return pairs.join(up_a, "a").join(up_b, ["b", "dst"]).groupBy("a", "b").agg(
        F.min(F.struct("depth", "dst"))["dst"].alias("common_super"))


#: Types that are asked as they are, without cutting them to those that still matter.
FEW = 10_000


def resolve_member(refs: DataFrame, members: DataFrame, types: DataFrame, interfaces: DataFrame | None = None,
                   wild_refs: bool = True, wild_decls: bool = True) -> DataFrame:
    """Nearest type at or above ``refs(container, type_name, name, descriptor)`` that declares the member.

    At every step the type copy in the container of the reference is preferred; without one the first container
    that holds the type is used. Descriptors may hold wildcards on both sides. Result: distinct references with
    ``found_type`` and ``depth``, both null when nothing declares the member. Only superclasses are walked,
    unless ``interfaces(container, type_name, super_name)`` is given.

    References, types and copies of types (spots) are walked as numbers. A step asks types that lie above others by as
    many steps only, so members, copies and edges are cut to these whenever they have halved.
    """
    scratch = Scratch(refs.sparkSession, "member")
    ident = ["container", "type_name", "name", "descriptor"]
    number = F.monotonically_increasing_id()
    wanted, _ = scratch.save(refs.select(*ident).distinct().withColumn("_ref", number), "refs")
    root_of_interface = has_flag("flags", INTERFACE) & (F.col("super_name") == "java/lang/Object")
    supers = types.select("container", "type_name",
                          F.when(~root_of_interface, F.col("super_name")).alias("super_name"))
    if interfaces is not None:
        supers = supers.unionByName(interfaces.select("container", "type_name", "super_name"))
    copies = types.select("container", F.col("type_name").alias("at")).dropna().distinct()
    boxes, _ = scratch.save(copies.select("container").distinct().withColumn("_box", number), "boxes")
    names, n_types = scratch.save(copies.groupBy("at").agg(F.min("container").alias("first")).withColumn("_type", number), "names")
    spots, _ = scratch.save(copies.join(names, "at").join(boxes, "container").select(
        "container", "_box", "at", "_type", (F.col("container") == F.col("first")).alias("is_first")).withColumn("_spot", number), "spots")
    homes = spots.filter("is_first").select("at", "_type", F.col("_spot").alias("_home"))
    above = homes.select(F.col("at").alias("super_name"), F.col("_type").alias("_next"), F.col("_home").alias("_next_home"))
    up, n_up = scratch.save(supers.dropna().join(above, "super_name").withColumnRenamed("type_name", "at").join(
        spots, ["container", "at"]).select("_spot", "_type", "_next", "_next_home").distinct(), "up")
    local = spots.select("_box", "_type", "_spot")
    # One way up from everywhere, as for classes: whoever meets the type marked last goes round a cycle.
    one_way = n_up == up.select("_spot").distinct().count()

    # What no reference asks for is not looked at, and a member that no type declares needs no walk.
    filled = wanted.dropna()
    keys, _ = scratch.save(meet_refs(filled, "descriptor", wild_refs, wild_decls).select("name", "_meet").distinct(), "keys")
    declared, _ = scratch.save(
        meet_decls(members.select("container", F.col("type_name").alias("at"), "name", F.col("descriptor").alias("declared")),
                   "declared", wild_refs, wild_decls)
        .join(keys, ["name", "_meet"], "left_semi").distinct().join(spots, ["container", "at"])
        .select("_spot", "_type", "name", "declared", "_meet"), "declared")
    keys, _ = scratch.save(declared.select("name", "_meet").distinct(), "answers")
    walked = ["_ref", "_box", "name", "descriptor"]
    frontier = meet_refs(filled, "descriptor", wild_refs, wild_decls).join(keys, ["name", "_meet"], "left_semi").join(
        boxes, "container", "left").join(homes, F.col("type_name") == F.col("at")).select(
        *walked, "_type", "_home", F.lit(None).cast("bigint").alias("_mark"))
    if wild_decls:
        frontier = frontier.distinct()
    reach, kept = names.select("_type"), n_types
    steps: list[str] = []
    seen: list[str] = []
    while True:
        depth = len(seen)
        if seen and kept > FEW:
            reach, n = scratch.save(up.join(reach, "_type", "left_semi").select(F.col("_next").alias("_type")).distinct(), f"reach-{depth}")
            if 2 * n <= kept:
                up, local, declared = (scratch.save(t.join(reach, "_type", "left_semi"), f"{c}-{depth}")[0]
                                       for c, t in (("up", up), ("local", local), ("declared", declared)))
                kept = n
        if seen and not one_way and _doubled(depth):
            # Where ways part, a reference may come back to where it was.
            frontier = frontier.join(scratch.read(*seen).select("_ref", "_type"), ["_ref", "_type"], "left_anti")
        placed, n = scratch.save(frontier.join(local, ["_box", "_type"], "left").select(
            *walked, "_type", F.coalesce("_spot", "_home").alias("_spot"), "_mark"), f"at-{depth}")
        if n == 0:
            break
        seen.append(f"at-{depth}")
        asked = meet_refs(placed, "descriptor", wild_refs, wild_decls).alias("r")
        same = [F.col(f"r.{k}") == F.col(f"d.{k}") for k in ("_spot", "name", "_meet")]
        if wild_refs or wild_decls:
            same.append(F.when(F.col("r._meet").startswith("="), True).otherwise(
                descriptors_match("r.descriptor", "d.declared")))
        # A semi join: references that crowd on one member are never multiplied.
        hits = asked.join(declared.alias("d"), same, "left_semi").select(F.col("r._ref").alias("_ref"), F.col("r._type").alias("_type"))
        if wild_decls:
            hits = hits.distinct()
        hits, n = scratch.save(hits.withColumn("depth", F.lit(depth)), f"found-{depth}")
        steps.append(f"found-{depth}")
        rest = placed.join(hits.select("_ref"), "_ref", "left_anti") if n else placed
        mark = F.col("_type") if _doubled(depth) else F.col("_mark")
        frontier = rest.withColumn("_mark", mark if one_way else F.col("_mark")).join(up.drop("_type"), "_spot").select(
            *walked, F.col("_next").alias("_type"), F.col("_next_home").alias("_home"), "_mark")
        frontier = frontier.filter(F.col("_type") != F.col("_mark")) if one_way else frontier.distinct()
    if not steps:
        return wanted.select(*ident, F.lit(None).cast("string").alias("found_type"), F.lit(None).cast("int").alias("depth"))
    # Several parents, or copies of a type in one container, may find the member more than once.
    found = scratch.read(*steps).join(names.select("_type", F.col("at").alias("found_type")), "_type").groupBy("_ref").agg(
        F.min(F.struct("depth", "found_type")).alias("n"))
    return wanted.join(found, "_ref", "left").select(
        *ident, F.col("n.found_type").alias("found_type"), F.col("n.depth").alias("depth"))


def compact_tree(directories: DataFrame, files: DataFrame) -> DataFrame:
    """Merge chains of directories that hold exactly one child, a directory.

    ``directories(container, entry_path)`` and ``files(container, entry_path)``. One row per shown directory:
    ``entry_path`` (the deepest of its chain), ``head_path`` and the dotted ``label``.
    """
    d = directories.select("container", "entry_path").distinct()
    cut = F.length("entry_path") - F.length(simple_name("entry_path")) - 1
    parent = F.substring(F.col("entry_path"), F.lit(1), cut)
    children = (
        d.select("container", "entry_path", F.lit(1).alias("is_dir"))
        .unionByName(files.select("container", "entry_path").distinct().withColumn("is_dir", F.lit(0)))
        .withColumn("parent", parent)
        .groupBy("container", "parent")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("is_dir").alias("n_dir"), F.min("entry_path").alias("only"))
        .filter((F.col("n") == 1) & (F.col("n_dir") == 1) & (F.col("parent") != ""))
    )
    scratch = Scratch(d.sparkSession, "compact")
    links, _ = scratch.save(children.select("container", F.col("parent").alias("head"), "only"), "links")
    key = lambda c: F.concat_ws("\u0001", "container", c)
    ends = tops(links.select(key("head").alias("src"), key("only").alias("dst")), scratch)
    tails = ends.select(
        F.substring_index("src", "\u0001", 1).alias("container"),
        F.substring_index("src", "\u0001", -1).alias("entry_path"),
        F.substring_index("top", "\u0001", -1).alias("tail_path"))
    merged = links.select("container", F.col("only").alias("entry_path"))
    tail = F.coalesce("tail_path", "entry_path")
    return (
        d.join(merged, ["container", "entry_path"], "left_anti")
        .join(tails, ["container", "entry_path"], "left")
        .select("container", tail.alias("entry_path"), F.col("entry_path").alias("head_path"),
                F.translate(F.substring(tail, cut + 2, F.length(tail)), "/", ".").alias("label"))
    )
