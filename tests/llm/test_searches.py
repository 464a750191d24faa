"""Hard negatives, the prefix trie and collision counting against brute force, and on odd tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from briefloom.llm import collisions, negatives, prefixtrie, queries

FOLDER = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<float>, label int, score string, row int"


# 11 hard negatives


def test_products_modulo_primes_are_exact():
    rng = np.random.default_rng(5)
    for most, depth in ((100, 64), (1000, 3000), (2**28, 30), (1, 1)):
        a, b = rng.integers(-most, most + 1, (9, depth)), rng.integers(-most, most + 1, (13, depth))
        moduli = negatives.primes(depth * most * most)
        assert (negatives.products(negatives.residues(a, moduli), negatives.residues(b, moduli), moduli) == a @ b.T).all()
    for x in (2**62, -(2**62), 2**63 - 1, -(2**63) + 1, 0):
        moduli = negatives.primes(2**63 - 1)
        assert negatives.reconstructed([np.array([x % p], dtype=np.int32) for p in moduli], moduli)[0] == x


def plain_negatives(rows, positives=5, negatives_=5):
    """rows: (id, vector, label). Ids are distinct."""
    whole = {i: [int(np.floor(256 * float(x))) for x in v] for i, v, _ in rows}
    label = {i: y for i, _, y in rows}
    score = lambda a, b: sum(x * y for x, y in zip(whole[a], whole[b], strict=False))
    out = set()
    for a in [i for i in whole if i % 100 == 0]:
        order = sorted((-score(a, i), i) for i in whole if i != a)
        near = [(-s, i) for s, i in order if label[i] == label[a]][:positives]
        for reach, p in near:
            inside = [(-s, i) for s, i in order if label[i] != label[a] and 80 * reach <= -100 * s <= 100 * reach][:negatives_]
            out |= {(a, p, rank, i, reach, s) for rank, (s, i) in enumerate(inside, 1)}
    return out


def test_negatives_over_many_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-4, 5, 6 if i % 9 else 4) / 16).tolist(), int(rng.integers(0, 4))) for i in range(900)]  # many ties
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS).repartition(5)
    got = negatives.mine(df, F.col("vec_id") % 100 == 0, block=700, group=20).collect()
    expected = plain_negatives(rows)
    assert len(got) == len(expected) and set(map(tuple, got)) == expected


def test_negatives_of_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.1], 2), (None, [0.9, 0.1], 2), (3, None, 1), (4, [1.0, None], 1), (5, [nan, 1.0], 2), (6, [inf, 1.0], 2),
            (8, [1.0, 0.0], None), (9, [], 2), (100, [], 1), (200, [1.0, 0.0], 3), (200, [1.0, 0.0], 3)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    anchor = F.col("vec_id") % 100 == 0
    got = [tuple(r) for r in negatives.mine(df, anchor).collect()]
    # The positive of 0 is 1 with 256 * 256; its negatives lie between 80 and 100 percent of that, ties by id.
    assert [r[2:] for r in sorted(got, key=lambda r: r[2]) if r[:2] == (0, 1)] == [(1, 200, 65536, 65536), (2, 200, 65536, 65536), (3, 2, 65536, 58880), (4, None, 65536, 58880)]
    # The empty vector has the score 0 with every row, so all others of another label are in the window.
    assert len([r for r in got if r[:2] == (100, 0)]) == 5
    assert len([r for r in got if r[:2] == (200, 200)]) == 2 * 4  # two anchors, each the other's positive
    none = spark.createDataFrame([], VECTORS)
    assert negatives.mine(none, anchor).count() == 0 and negatives.mine(df, F.lit(None).cast("boolean")).count() == 0
    with pytest.raises(ValueError):
        negatives.mine(spark.createDataFrame([(0, [3e30], 1, "x", 1)], VECTORS), anchor)


# 12 the prefix trie


def plain_trie(turns):
    """turns: (conv, turn, role, text); turns of a conversation are distinct."""
    own = defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        built[c] = tuple(own.get(base, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, p in built.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    below = {}
    for p in sorted(members, key=len, reverse=True):
        below[p] = (sum(below[k][0] for k in kids[p]) or 1, (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(below[k][1] for k in kids[p]))

    out = []
    for p, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if len(built[c]) == len(p))))
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(kids[p]), *below[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def family(seed, n=300):
    """Conversations with few different turns, so that prefixes are shared at all depths."""
    rnd = random.Random(seed)
    turns = []
    for c in [*range(n), *range(5000, 5050), -7, -100, 1000]:
        if c == 200:
            continue  # a family without its first
        size = 0 if c == 17 else rnd.choice([1, 1, 2, 3, 4, 6, 9, 14])
        turns += [(c, t if t else None, rnd.choice(["user", "user", None]), rnd.choice(["a", "bb", "ccc é", None]) if rnd.random() < 0.9 or c % 3 else f"own {c} {t}") for t in range(size)]
    turns += [(c, t, "user", f"same {t}") for c in range(7000, 7090) for t in range(9)]  # a large group of copies
    turns += [(9000, t, "user", f"long {t}") for t in range(2500)]  # a conversation longer than a chunk
    return turns


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("shard", [1 << 14, 40, 5])
def test_trie_against_brute_force(spark, shard):
    turns = family(shard)
    df = spark.createDataFrame(turns, SCHEMA).withColumn("node", F.lit("taken")).repartition(6)
    got = sorted((tuple(r) for r in prefixtrie.trie(df, shard=shard).collect()), key=str)
    assert got == plain_trie(turns)


def test_shards_split_at_the_skeleton(spark):
    paths = [([(f"{i:032x}", i), (f"{j:032x}", j)], 1, 0, 10 * i + j) for i in range(1, 5) for j in range(20 * i, 20 * i + 9)]
    df = spark.createDataFrame(paths, "path array<struct<node:string,n:long>>, members long, tails long, least long")
    cuts = prefixtrie.splitters(df, 12)
    assert 3 <= len(cuts) <= 8 and cuts == sorted(cuts)
    skeleton = prefixtrie.Skeleton(cuts)
    assert skeleton.children[""] == len({p[0][0] for p in cuts}) and len({skeleton.shard("".join(x for x, _ in p)) for p, *_ in paths}) == len(cuts) + 1


def test_trie_of_odd_tables(spark):
    assert prefixtrie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefixtrie.trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0
    twice = spark.createDataFrame([(100, 1, "user", "x"), (100, 1, "user", "x"), (100, None, None, None)], SCHEMA)
    assert sorted(tuple(r)[:7] for r in prefixtrie.trie(twice).collect()) == [(100, d, 100 if d else None, 1, int(d < 3), 1, 0) for d in range(4)]
    same = spark.createDataFrame([(c, 0, "user", "long " * 50_000) for c in (5, 6)], "conv_id int, turn int, role string, text string")
    assert {r["n_convs"] for r in prefixtrie.trie(same).collect()} <= {1, 2}


# 13 collision counting


def recall(spark, df, step, k=20, **sizes):
    got = defaultdict(list)
    for r in collisions.neighbours(df, F.col("vec_id") % step == 0, k=k, **sizes).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    rows = {r["vec_id"]: np.array(r["embedding"], dtype=np.float64) for r in df.collect()}
    hit = wanted = 0
    for q in [i for i in rows if i % step == 0]:
        order = sorted((-float((rows[q] * v).sum()), i) for i, v in rows.items() if i != q)[:k]
        found = sorted(got[q])
        assert [f[0] for f in found] == list(range(1, len(order) + 1))
        for _, i, s in found:
            assert s == pytest.approx(float(rows[q] @ rows[i]), rel=1e-12, abs=1e-15)
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        hit += len({f[1] for f in found} & {i for _, i in order})
        wanted += len(order)
    return hit / wanted


def test_neighbours_recall_on_whole_tables(spark):
    for scale in ("sf0.01", "sf0.1"):
        df = spark.read.parquet(f"/root/testdata/{scale}/embeddings.parquet").select("vec_id", "embedding")
        assert recall(spark, df, 20) >= 0.95
    assert recall(spark, df, 20, block=64 * 700, group=64 * 30) >= 0.95  # three blocks, four groups


def test_neighbours_of_clusters_and_lengths(spark):
    """Rows in tight clusters, of very different lengths: few rows are verified and nearly all neighbours found."""
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((40, 32))
    rows = [(i, ((centres[i % 40] + 0.05 * rng.standard_normal(32)) * (0.5 + (i % 7) / 7)).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert recall(spark, df, 100) >= 0.9


def test_neighbours_of_odd_tables(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [1.0, None]), (None, [1.0, 0.0]), (7, []), (8, [-1.0]), (40, [1.0, 0.0]), (40, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    got = defaultdict(list)
    for r in collisions.neighbours(df, F.col("vec_id") % 20 == 0, k=5).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got[0]) == [(1, 2, 2.0), (2, 1, 1.0), (3, 40, 1.0), (4, 40, 1.0), (5, None, 1.0)]
    assert len(got[40]) == 10 and sorted(got) == [0, 40]
    assert collisions.neighbours(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert len(collisions.neighbours(df, F.col("vec_id") == 0, k=100).collect()) == 6  # all candidates, if fewer


def test_registered_searches(spark):
    for name in ("op11_hard_negatives", "op12_prefix_trie", "op13_collision_neighbours"):
        assert queries.QUERIES[name](spark, FOLDER).count() > 0
