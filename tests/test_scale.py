"""Group-wise helpers against brute force, with one group holding most rows."""

import os
import random

from pyspark.sql import functions as F

from briefloom import scale
from briefloom.operators import budget as bg
from briefloom.session import cut_lineage, discard


def rows(seed=7):
    rnd = random.Random(seed)
    return [("hot" if rnd.random() < 0.7 else f"g{rnd.randrange(5)}", i, rnd.randrange(9), rnd.choice([None, i])) for i in range(600)]


def test_running_numbers_and_sums(spark):
    data = rows()
    df = spark.createDataFrame(data, "g string, i int, v int, w int")
    out = scale.running(df, ["g"], scale.position_chunk("i", 50), ["i"], {"before": F.col("v")}, number="n").collect()
    for r in out:
        earlier = [d for d in data if d[0] == r.g and d[1] < r.i]
        assert r.before == sum(d[2] for d in earlier) and r.n == len(earlier) + 1


def test_latest_and_previous(spark):
    data = rows()
    df = spark.createDataFrame(data, "g string, i int, v int, w int")
    chunk = scale.position_chunk("i", 37)
    last = {r.i: r.x for r in scale.latest_before(df, ["g"], chunk, ["i"], {"x": F.col("w")}).collect()}
    prev = {r.i: r.x for r in scale.previous(df, ["g"], chunk, ["i"], {"x": F.col("w")}).collect()}
    for g, i, _, _ in data:
        mine = [d for d in data if d[0] == g and d[1] <= i]
        seen = [d[3] for d in mine if d[3] is not None]
        assert last[i] == (seen[-1] if seen else None)
        assert prev[i] == (mine[-2][3] if len(mine) > 1 else None)


def test_a_null_key_of_several_chunks_keeps_what_it_carries(spark):
    data = [(None if i % 2 else "a", i, i if i % 31 == 3 else None) for i in range(400)]
    df = spark.createDataFrame(data, "g string, i int, w int")
    got = {r.i: r.x for r in scale.latest_before(df, ["g"], scale.position_chunk("i", 25), ["i"], {"x": F.col("w")}).collect()}
    for g, i, _ in data:
        seen = [d[2] for d in data if d[0] == g and d[1] <= i and d[2] is not None]
        assert got[i] == (seen[-1] if seen else None)


def test_a_loop_over_cuts_keeps_plans_and_estimates_small(spark):
    df = spark.range(40).select("id", (F.col("id") + 1).alias("to a;b"))
    for _ in range(12):
        df, old = cut_lineage(df.join(df.select(F.col("to a;b").alias("id"), F.col("id").alias("before")), "id").select("id", "to a;b")), df
    digits = len(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert digits < 8 and df.columns == ["id", "to a;b"] and df.count() == 28
    folder = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("//", "/")
    assert os.path.isdir(folder)
    discard(df)
    assert not os.path.isdir(folder)


def test_scan_matches_a_plain_loop(spark):
    df = spark.createDataFrame([(list(range(1, 700)),)], "a array<int>")
    got = df.select(scale.scan(F.col("a"), F.lit(0), lambda s, x: F.when(s + x > 50, x).otherwise(s + x), lambda s: s, "int", "int", 64)
                    .alias("v")).head().v
    want, s = [], 0
    for x in range(1, 700):
        s = x if s + x > 50 else s + x
        want.append(s)
    assert got == want


def test_contains_join(spark):
    hay = spark.createDataFrame([("d", 1, "看创新点这页"), ("d", 2, "none"), ("e", 3, "创新点")], "k string, id int, t string")
    needles = spark.createDataFrame([("d", "创新点"), ("d", "页"), ("e", "x")], "k string, n string")
    got = {(r.id, r.n) for r in scale.contains_join(hay, "t", needles, "n", ["k"]).collect()}
    assert got == {(1, "创新点"), (1, "页")}


def plain_apportion(weights, pool, cap):
    got, live = [0] * len(weights), [True] * len(weights)
    while any(live) and pool > 0:
        total = sum(w for w, x in zip(weights, live) if x)
        grants = [max(0, min(pool * w // total, cap - g)) if x else 0 for w, g, x in zip(weights, got, live)]
        got = [a + b for a, b in zip(got, grants)]
        live = [x and b > 0 and a < cap for x, a, b in zip(live, got, grants)]
        pool -= sum(grants)
        if not sum(grants):
            break
    return got


def test_apportion_on_bins_equals_block_by_block(spark):
    rnd = random.Random(3)
    cases = []
    for i in range(150):
        ws = [rnd.choice([50, 100, 300, 300, 550, 1000]) for _ in range(rnd.randrange(1, 12))]
        cases.append((i, ws, rnd.randrange(0, 400), rnd.choice([18, 28, 120])))
    df = spark.createDataFrame(cases, "i int, ws array<int>, pool int, cap int")
    bins = F.transform(F.array_distinct("ws"), lambda w: F.struct(w.alias("w"), F.size(F.filter("ws", lambda x: x == w)).alias("n")))
    out = {r.i: r.m for r in df.select("i", bg.apportion(bins, F.col("pool"), F.col("cap").cast("long")).alias("m")).collect()}
    for i, ws, pool, cap in cases:
        assert [out[i][w] for w in ws] == plain_apportion(ws, pool, cap)


def test_only_listed_groups_are_cut_and_all_are_numbered_alike(spark):
    data = [*rows(), *[(None, 1000 + i, i % 9, None) for i in range(60)], *[("g0", 1000 + i, i % 9, None) for i in range(3)]]
    df = spark.createDataFrame(data, "g string, i int, v int, w int")
    large = scale.large_groups(df, ["g"], 50)
    sizes = {g: sum(d[0] == g for d in data) for g in {d[0] for d in data}}
    assert {r[0][0] for r in large.collect()} == {g for g, n in sizes.items() if n > 50}
    for listed in (large, large.limit(0)):
        out = scale.running(df, ["g"], scale.position_chunk("i", 50), ["i"], {"before": F.col("v")}, number="n", large=listed).collect()
        assert len(out) == len(data)
        for r in out:
            earlier = [d for d in data if d[0] == r.g and d[1] < r.i]
            assert r.before == sum(d[2] for d in earlier) and r.n == len(earlier) + 1


def moves(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_numbered_rows_move_once(spark):
    """Rows, partial totals of chunks twice, and nothing more: the join finds the rows where the window left them."""
    df = spark.range(400).select((F.col("id") % 7).alias("g"), F.col("id").alias("i"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert moves(scale.running(df, ["g"], scale.position_chunk("i", 50), ["i"], number="n")) <= 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_line_items_are_numbered_by_place_before_they_are_written_out(spark, tmp_path):
    from briefloom.sources import corpus as c

    items = [(k, ln, p, s, float(q), 10.0 * q, 0.01 * q, "A") for k in (1, 2, None) for ln, p, s, q in ((2, 5, 1, 3), (1, 9000, 2, 4), (1, 7, 9, 5), (2, 5, 1, 2))]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, "
                                 "l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = c.placed_blocks(spark, str(tmp_path))
    assert {(r.slide_uid, r.line_no, r.part_key, r.units, r.block_no) for r in got.collect()} == {
        (k, ln, p, q, n) for k in (1, 2, None) for n, (ln, p, q) in enumerate(((1, 7, 5), (1, 9000, 4), (2, 5, 2), (2, 5, 3)), 1)}
    plain = c.numbered_blocks(c.num_blocks(spark, str(tmp_path)))
    assert sorted(map(str, got.select(*sorted(plain.columns)).collect())) == sorted(map(str, plain.select(*sorted(plain.columns)).collect()))
