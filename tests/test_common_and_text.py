"""Common super types by binary lifting and numbered text hits against plain versions."""

import random
import re

from pyspark.sql import functions as F

from symlake.operators import hierarchy, text


def line(up, a):
    out = [a]
    while out[-1] in up and up[out[-1]] not in out:
        out.append(up[out[-1]])
    return out


def test_common_super_against_brute_force(spark):
    rnd = random.Random(3)
    up = {f"n{i}": f"n{rnd.randrange(i)}" for i in range(1, 60)} | {f"m{i}": f"m{i - 1}" for i in range(1, 40)}
    up |= {"x": "a", "a": "b", "b": "a", "y": "b"}
    types = spark.createDataFrame([("c", k, v, 1) for k, v in up.items()] + [("c", "s", "s", 1)],
                                  "container string, type_name string, super_name string, flags int")
    names = [*sorted(set(up) | set(up.values())), "s", "lost"]
    pairs = [(rnd.choice(names), rnd.choice(names)) for _ in range(400)]
    pairs += [("x", "y"), ("y", "x"), ("lost", "lost"), ("n5", "n5"), ("n5", "n5"), (None, "n1"), ("n1", None), ("x", "n3"), ("s", "s"), ("m39", "m0")]
    want = []
    for a, b in pairs:
        shared = [t for t in line(up, a) if t in set(line(up, b))] if a and b else []
        want.append((a, b, shared[0] if shared else None))
    got = hierarchy.first_common_super(spark.createDataFrame(pairs, "a string, b string"), types)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    nothing = hierarchy.first_common_super(spark.createDataFrame([], "a string, b string"), types.limit(0))
    assert nothing.count() == 0


def test_hits_across_blocks(spark):
    sizes = (0, 1, text.BLOCK - 1, text.BLOCK, text.BLOCK + 1, 3 * text.BLOCK)
    texts = [(k, "ü ab" * n + "z") for k, n in enumerate(sizes)] + [(len(sizes), None), (len(sizes) + 1, "")]
    df = spark.createDataFrame(texts, "id int, t string")
    want = [(k, n, m.start(), m.end()) for k, t in texts if t for n, m in enumerate(re.finditer("ab", t))]
    assert sorted(map(tuple, text.find_text(df, ["id"], "t", "ab").collect())) == sorted(want)


def test_many_hits_in_one_text(spark):
    n = 50_000
    df = spark.range(1).select("id", F.repeat(F.lit("ab "), n).alias("t"))
    got = text.find_text(df, ["id"], "t", "ab").agg(F.count(F.lit(1)), F.sum(F.col("hit_start") - 3 * F.col("hit_no")), F.max("hit_end")).first()
    assert tuple(got) == (n, 0, 3 * n - 1)


def test_short_chains_are_met_in_three_moves_and_long_ones_by_lifting(spark, monkeypatch):
    up = {f"t{i}": f"t{i // 3}" for i in range(1, 200)}
    types = spark.createDataFrame([("c", t, s, 0) for t, s in up.items()], "container string, type_name string, super_name string, flags int")
    pairs = spark.createDataFrame([(f"t{i}", f"t{i * 7 % 230}") for i in range(0, 230)] + [("t5", "t5"), ("t5", "t5"), ("x", "x"), (None, "t5")], "a string, b string")
    short = hierarchy.first_common_super(pairs, types)
    assert str(short._jdf.queryExecution().analyzed()).count("Join") <= 3
    monkeypatch.setattr(hierarchy, "LINE", 2)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, short.collect())) == sorted(map(key, hierarchy.first_common_super(pairs, types).collect()))
