"""Hard-negative mining on exact integer scores from a residue number system.

Every matrix product is taken modulo several small primes in float32: residues lie between -p/2 and p/2, and sums of
``DEPTH`` products stay below 2**24, so float32 holds them exactly whatever order they are added in. Chinese
remaindering with balanced mixed-radix digits gives back the signed scores. The primes are as many as the data need.

First the best rows of an anchor's own label are found (its positives), block by block and merged; then, per positive,
the best rows of other labels whose score lies in a window below the positive's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.llm.blocks import best, cells, deal, finite, matrix
from briefloom.llm.shared import cut_lineage, discard
from briefloom.scale import top_rows

DEPTH = 1024  # products per sum: 1024 * 125**2 < 2**24
TILE = 256  # anchors scored at a time
SCALE = 256
MOST = (1 << 63) - 1


def primes(bound: int) -> list[int]:
    """The largest primes below 256, as many as it takes for their product to exceed ``2 * bound``."""
    out, product = [], 1
    for n in range(255, 2, -1):
        if product > 2 * bound:
            break
        if all(n % d for d in range(2, int(n**0.5) + 1)):
            out.append(n)
            product *= n
    return out or [251]


def balanced(x: np.ndarray, p: int) -> np.ndarray:
    """Residues between -(p - 1) / 2 and (p - 1) / 2."""
    x = x % p
    return x - p * (x > p // 2)


def residues(x: np.ndarray, moduli: list[int]) -> list[np.ndarray]:
    return [balanced(x, p).astype(np.float32) for p in moduli]


def products(a: list[np.ndarray], b: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """Exact integer matrix of inner products of the rows of ``a`` and ``b``, both given by their residues."""
    found = []
    for x, y, p in zip(a, b, moduli, strict=True):
        total = np.zeros((len(x), len(y)), dtype=np.int32)
        for k in range(0, x.shape[1], DEPTH):
            total = (total + (x[:, k:k + DEPTH] @ y[:, k:k + DEPTH].T).astype(np.int32)) % p
        found.append(total)
    return reconstructed(found, moduli)


def reconstructed(found: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """The signed numbers of least magnitude with the given residues; they must fit 64 bits."""
    value, digits, unit = np.zeros(found[0].shape, dtype=np.int64), [], 1
    for i, (r, p) in enumerate(zip(found, moduli, strict=True)):
        known, step = np.zeros_like(r), 1
        for d, q in zip(digits, moduli[:i], strict=True):
            known = (known + d * step) % p
            step = step * q % p
        digit = balanced((r - known) * pow(unit, -1, p), p)
        digits.append(digit)
        value += digit.astype(np.int64) * np.int64((unit + (1 << 63)) % (1 << 64) - (1 << 63))  # modulo 2**64, as all of it
        unit *= p
    return value


def ranked(table: pa.Table, key: str) -> pa.Table:
    """In order of the key, nulls last, so that ties go to the smaller one."""
    return table.sort_by([(key, "ascending"), ("row", "ascending")])


def mine(rows: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE,
         positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, **sizes) -> DataFrame:
    """Hard negatives of every anchor and positive: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become ``floor(scale * x)``. Rows with a null label, a null vector or a component that is null or not
    finite take no part. ``anchor`` says which rows are anchors; their positives are the first ``positives`` other rows of the
    same label, and the negatives of a positive the first ``negatives`` rows of other labels with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``. Higher scores come first, ties by smaller key
    (null last). Rows that repeat a key are rows of their own, as candidates and as anchors; a shorter vector counts as
    filled up with zeros; an empty table gives an empty result; other columns play no part. Scores that 64 bits cannot
    hold raise an error.
    """
    whole = lambda x: F.floor(x.cast("double") * F.lit(float(scale)))
    base = (rows.filter(finite(vector) & F.col(label).isNotNull())
            .select(F.col(key).alias("key"), F.col(label).alias("label"), F.transform(vector, whole).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("is_anchor")))
    dealt = deal(base, F.col("is_anchor"), **sizes)
    width, bound = dealt.longest, int(dealt.largest) ** 2 * max(1, dealt.longest)
    if bound >= 1 << 63:
        raise ValueError("the scores of these vectors do not fit 64 bits")
    moduli = primes(bound)
    kind = rows.schema[key].dataType.simpleString()

    def tiles(block: pa.Table, asked: pa.Table):
        """(anchor number, scores of the block's rows) of every anchor."""
        there = residues(matrix(block["vector"], width, np.int64), moduli)
        own = matrix(asked["vector"], width, np.int64)
        for at in range(0, len(own), TILE):
            yield from enumerate(products(residues(own[at:at + TILE], moduli), there, moduli), at)

    def nearest(block: pa.Table, asked: pa.Table) -> pa.Table:
        block, out = ranked(block, "key"), []
        labels, number = block["label"].to_numpy(), block["row"].to_numpy()
        want, who = asked["label"].to_numpy(), asked["row"].to_numpy()
        for i, score in tiles(block, asked):
            some = np.flatnonzero((labels == want[i]) & (number != who[i]))
            some = some[best(score[some], positives)]
            out.append((np.full(len(some), who[i]), some, score[some]))
        who, at, score = map(np.concatenate, zip(*out, strict=True))
        return pa.table([pa.array(who), pa.array(number[at]), pa.array(score), block["key"].take(pa.array(at))], names=["anchor", "row", "score", "key"])

    asked = dealt.queries()
    found = cells(dealt, asked, nearest, f"anchor long, row long, score long, key {kind}")
    order = [F.desc("score"), F.asc_nulls_last("key"), F.asc("row")]
    chosen = cut_lineage(top_rows(found, ["anchor"], order, positives, "no").select("anchor", "no", F.col("key").alias("positive_id"), F.col("score").alias("positive_score")))
    held = chosen.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("no", "positive_score"))).alias("held"))

    def windowed(block: pa.Table, asked: pa.Table) -> pa.Table:
        block, out = ranked(block, "key"), []
        labels, number = block["label"].to_numpy(), block["row"].to_numpy()
        want, who, held = asked["label"].to_numpy(), asked["row"].to_numpy(), asked["held"].to_pylist()
        for i, score in tiles(block, asked):
            other = np.flatnonzero(labels != want[i])
            score = score[other]
            for h in held[i]:
                reach = h["positive_score"]
                least, most = (max(-MOST, min(MOST, x)) for x in (-(-low * reach // 100), high * reach // 100))
                inside = np.flatnonzero((score >= least) & (score <= most))
                inside = inside[best(score[inside], negatives)]
                out.append((np.full(len(inside), who[i]), np.full(len(inside), h["no"], dtype=np.int32), other[inside], score[inside]))
        who, no, at, score = map(np.concatenate, zip(*out, strict=True))
        return pa.table([pa.array(who), pa.array(no), pa.array(number[at]), pa.array(score), block["key"].take(pa.array(at))], names=["anchor", "no", "row", "negative_score", "key"])

    ready = asked.join(held.withColumnRenamed("anchor", "row"), "row")
    windows = cells(dealt, ready, windowed, f"anchor long, no int, row long, negative_score long, key {kind}")
    order = [F.desc("negative_score"), F.asc_nulls_last("key"), F.asc("row")]
    taken = top_rows(windows, ["anchor", "no"], order, negatives, "rank").select("anchor", "no", "rank", F.col("key").alias("negative_id"), "negative_score")
    named = asked.select(F.col("row").alias("anchor"), F.col("key").alias("anchor_id"))
    return (taken.join(chosen, ["anchor", "no"]).join(named, "anchor")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
