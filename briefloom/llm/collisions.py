"""Approximate nearest neighbours by collision counting over single projections.

Within a block of rows, vectors are projected on ``LINES`` random directions and every projection is a sorted array. A
query opens a window around its own projection in each array; the window's ends are ranks in that array, and rows that
lie in ``THRESHOLD`` windows or more are verified by their exact inner product. Virtual rehashing widens the windows
with the radius: first to the least radius of a ladder at which ``FIRST * k`` rows pass, then to the distance of the
``k``-th best of those. Each row within that last radius has passed with a probability of at least ``1 - MISSED``. If too
few rows pass at the widest radius, all rows are verified; nothing is capped.

The largest inner product becomes the least distance: vectors are divided by the greatest norm of their block and get
one more component that brings all of them to length 1, queries are brought to length 1 with a last component of 0.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.llm.blocks import best, cells, deal, finite, matrix
from briefloom.scale import top_rows

LINES = 64
RATIO = 2.0  # of distances that the window's width tells apart best
MISSED = 0.03  # chance that a row just within the radius does not pass
FIRST = 16  # rows that pass first, times k
RADII = [0.2 * 1.15**i for i in range(17)]  # the ladder; no two points lie farther apart than 2
TILE = 128  # queries at a time

# Windows of width WINDOW * radius hold a row at the radius with probability NEAR.
WINDOW = math.sqrt(8 * RATIO**2 * math.log(RATIO) / (RATIO**2 - 1))
NEAR = math.erf(WINDOW / 2 / math.sqrt(2))


def _threshold() -> int:
    """The most collisions that a row at the radius reaches with a probability of ``1 - MISSED`` (binomial)."""
    tail, n = 0.0, LINES
    while tail < 1 - MISSED:
        tail += math.comb(LINES, n) * NEAR**n * (1 - NEAR) ** (LINES - n)
        n -= 1
    return n + 1


THRESHOLD = _threshold()


class Lines:
    """The sorted projections of a block, and the rank of every row in each."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.unit = float(np.abs(vectors).max(initial=0.0)) or 1.0  # keeps squares in range
        small = vectors / self.unit
        square = np.einsum("ij,ij->i", small, small)
        self.norm = math.sqrt(square.max(initial=0.0)) or 1.0
        last = np.sqrt(np.maximum(0.0, 1 - square / self.norm**2))
        self.directions = np.random.default_rng(13).standard_normal((vectors.shape[1] + 1, LINES))
        at = ((small / self.norm) @ self.directions[:-1] + last[:, None] * self.directions[-1]).T.copy()
        order = np.argsort(at, axis=1, kind="stable")
        self.values = np.take_along_axis(at, order, axis=1)
        self.ranks = np.empty(at.shape, dtype=np.uint16 if len(vectors) < 1 << 16 else np.uint32)
        np.put_along_axis(self.ranks, order, np.arange(len(vectors), dtype=self.ranks.dtype)[None, :], axis=1)

    def windows(self, at: np.ndarray, radius: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
        """First rank and number of ranks of every window (query x line), for queries projected to ``at``."""
        low, size = np.empty(at.shape, dtype=self.ranks.dtype), np.empty(at.shape, dtype=self.ranks.dtype)
        for i, values in enumerate(self.values):
            first = np.searchsorted(values, at[:, i] - WINDOW / 2 * radius, "left")
            low[:, i], size[:, i] = first, np.searchsorted(values, at[:, i] + WINDOW / 2 * radius, "right") - first
        return low, size

    def passing(self, low: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether each row lies in THRESHOLD of a query's windows; ranks below a window wrap around and so lie beyond it."""
        inside = (self.ranks - low[:, None]) < size[:, None]
        return inside.view(np.uint8).sum(axis=0, dtype=np.uint8) >= THRESHOLD

    def search(self, queries: np.ndarray, k: int, own: list[int]) -> list[tuple[np.ndarray, int]]:
        """Per query the positions of its ``k`` best verified rows, best first, and how many rows were verified.

        ``own`` are the queries' positions in this block, or -1.
        """
        unit = queries / np.abs(queries).max(axis=1, keepdims=True)
        at = (unit / np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None]) @ self.directions[:-1]
        ladder = [self.windows(at, r) for r in RADII]
        enough = min(FIRST * k, len(self.vectors))
        first, radius = [], np.full(len(queries), RADII[-1])
        for i, q in enumerate(queries):
            low, high = 0, len(RADII)  # the first radius that lets enough rows pass, if any
            held = {}
            while low < high:
                r = (low + high) // 2
                held[r] = self.passing(ladder[r][0][i], ladder[r][1][i])
                low, high = (low, r) if np.count_nonzero(held[r]) >= enough else (r + 1, high)
            some = np.flatnonzero(held[low]) if low < len(RADII) else np.arange(len(self.vectors))
            some = some[some != own[i]]
            score = self.vectors[some] @ q
            if len(some) >= k and low < len(RADII):
                worst = np.partition(score, len(score) - k)[len(score) - k]
                length = math.sqrt(float((q / self.unit) @ (q / self.unit))) * self.norm * self.unit**2
                radius[i] = max(RADII[low], math.sqrt(max(0.0, 2 - 2 * worst / length)))
            first.append((some, score, low < len(RADII) and radius[i] > RADII[low]))
        lows, sizes = self.windows(at, radius)
        out = []
        for i, (some, score, wider) in enumerate(first):
            if wider:
                new = self.passing(lows[i], sizes[i])
                new[some] = False
                new = np.flatnonzero(new)
                new = new[new != own[i]]
                some, score = np.concatenate([some, new]), np.concatenate([score, self.vectors[new] @ queries[i]])
            out.append((self.top(queries[i], some, score, k), len(some)))
        return out

    def top(self, query: np.ndarray, some: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
        if len(some) > k:
            worst = np.partition(score, len(score) - k)[len(score) - k]
            some = some[score >= worst - 1e-9 * max(1.0, abs(worst))]  # matrix products round differently from row to row
        some = np.sort(some)
        return some[best(exact(self.vectors[some], query), k)]


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed alike for every row, so that equal rows have equal scores."""
    return (vectors * query).sum(axis=1)


def neighbours(rows: DataFrame, query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, **sizes) -> DataFrame:
    """The ``k`` rows of largest inner product found for every query: ``query_id, rank, <key>, score``, and ``verified``, the
    number of rows verified in that row's block.

    ``query`` says which rows are queries; candidates are all rows but the query's own. Nearest first, ties by smaller key (null last),
    all candidates if fewer. Vectors that are null, zero, or hold a component that is null or not finite take no part. Rows that repeat
    a key are rows of their own; a shorter vector counts as filled up with zeros; an empty table gives an empty result; other columns
    play no part. The score is the inner product of the original vectors in double precision.
    """
    nonzero = F.exists(vector, lambda x: x != 0)
    base = (rows.filter(finite(vector)).filter(nonzero)
            .select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(query, F.lit(False)).alias("is_query")))
    dealt = deal(base, F.col("is_query"), **sizes)
    width = dealt.longest
    kind = rows.schema[key].dataType.simpleString()

    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        block = block.sort_by([("key", "ascending"), ("row", "ascending")])  # nulls last
        out = []
        there, number = matrix(block["vector"], width, np.float64), block["row"].to_numpy()
        place = {r: i for i, r in enumerate(number.tolist())}
        lines = Lines(there)
        who, own = asked["row"].to_numpy(), matrix(asked["vector"], width, np.float64)
        for start in range(0, len(own), TILE):
            part, asks = own[start:start + TILE], who[start:start + TILE].tolist()
            for q, a, (at, verified) in zip(part, asks, lines.search(part, k, [place.get(a, -1) for a in asks]), strict=True):
                out.append((np.full(len(at), a), at, exact(there[at], q), np.full(len(at), verified)))
        asks, at, score, verified = map(np.concatenate, zip(*out, strict=True))
        return pa.table([pa.array(asks), pa.array(number[at]), pa.array(score), pa.array(verified), block["key"].take(pa.array(at))], names=["query", "row", "score", "verified", "key"])

    asked = dealt.queries()
    found = cells(dealt, asked, run, f"query long, row long, score double, verified long, key {kind}")
    ranked = top_rows(found, ["query"], [F.desc("score"), F.asc_nulls_last("key"), F.asc("row")], k)
    named = asked.select(F.col("row").alias("query"), F.col("key").alias("query_id"))
    return ranked.join(named, "query").select("query_id", "rank", F.col("key").alias(key), "score", "verified")
