"""Benchmark decontamination: SimHash fingerprints of item-sized windows, multi-index search, exact verification.

The items are the query set and are held in blocks of bounded size, each broadcast and searched against every text. A
window can reach the similarity only if it shares a shingle with the item, so only the windows that cover a shared
shingle are fingerprinted; this loses nothing. All fingerprints within the Hamming radius are found: with ``radius + 1``
blocks of bits, two fingerprints within the radius agree in one block at least, and each block has its own index. The
candidates are verified by weighted Jaccard similarity of shingles.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from briefloom.llm.arrays import U, Words, mix, words
from briefloom.llm.shared import in_batches

WIDTH, SIMILARITY, RADIUS = 5, 0.8, 16
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
RUN = 4096  # windows fingerprinted at a time
_BUILT: dict = {}


def simhash(h: np.ndarray, size: int, starts: np.ndarray) -> np.ndarray:
    """64-bit SimHash of the word windows ``h[s:s + size]``, every occurrence of a word counting once."""
    if not len(starts):
        return np.empty(0, U)
    low = int(starts.min())
    part = mix(h[low:int(starts.max()) + size])
    bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int8) * 2 - 1
    sums = np.zeros((len(part) + 1, 64), dtype=np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=sums[1:])
    at = starts - low
    return np.packbits(sums[at + size] > sums[at], axis=1).view(U).reshape(-1)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Hamming:
    """Fingerprints under ``radius + 1`` block indexes."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        edges = np.linspace(0, 64, min(radius + 1, 64) + 1).astype(int)
        self.blocks = [(U(a), U((1 << int(b - a)) - 1)) for a, b in zip(edges, edges[1:], strict=False)]
        self.tables = []
        for shift, mask in self.blocks:
            value = (prints >> shift) & mask
            order = np.argsort(value, kind="stable")
            self.tables.append((value[order], order))

    def near(self, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probe, fingerprint) index pairs within the radius, each once."""
        found = []
        for (shift, mask), (value, order) in zip(self.blocks, self.tables, strict=True):
            key = (probes >> shift) & mask
            a, b = np.searchsorted(value, key, "left"), np.searchsorted(value, key, "right")
            who = np.repeat(np.arange(len(probes)), b - a)
            at = np.arange(len(who)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
            other = order[at]
            good = distance(probes[who], self.prints[other]) <= self.radius
            found.append(who[good] * len(self.prints) + other[good])
        pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        return pairs // max(1, len(self.prints)), pairs % max(1, len(self.prints))


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two multisets of hashes."""
    both = np.concatenate([a, b])
    if not len(both):
        return 0.0
    _, group = np.unique(both, return_inverse=True)
    left = np.bincount(group[:len(a)], minlength=group.max() + 1)
    right = np.bincount(group[len(a):], minlength=group.max() + 1)
    return float(np.minimum(left, right).sum() / np.maximum(left, right).sum())


class Items:
    """A block of benchmark items: word hashes, shingles and, per item size, an index of fingerprints."""

    def __init__(self, ids: list, texts: list[str], width: int, radius: int):
        self.width, self.radius = width, radius
        self.ids: list = []
        self.hashes: list[np.ndarray] = []
        for w in words(pa.array(texts, pa.string())):
            for i in range(w.rows):
                if w.at[i] < w.at[i + 1]:  # an item without words matches nothing
                    self.ids.append(ids[w.first + i])
                    self.hashes.append(w.hashes[w.at[i]:w.at[i + 1]])
        self.size = np.array([len(h) for h in self.hashes], dtype=np.int64)
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.shingles = [self._of(h) for h in self.hashes]
        for n in sorted({min(width, s) for s in self.size}):
            own = np.flatnonzero(np.minimum(self.size, width) == n)
            item = np.repeat(own, [len(self.shingles[i]) for i in own])
            offset = np.concatenate([np.arange(len(self.shingles[i])) for i in own])
            value = np.concatenate([self.shingles[i] for i in own])
            order = np.argsort(value, kind="stable")
            self.by_width[n] = value[order], item[order], offset[order]
        self.prints = np.array([simhash(h, len(h), np.zeros(1, np.int64))[0] for h in self.hashes], dtype=U)
        self.index = {int(s): (own := np.flatnonzero(self.size == s), Hamming(self.prints[own], radius)) for s in set(self.size.tolist())}

    def _of(self, h: np.ndarray) -> np.ndarray:
        return _rolled(h, min(self.width, len(h)))


def _rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Shingles of ``width`` words; as ``Words.shingles`` makes them."""
    out = h[:len(h) - width + 1].copy()
    for k in range(1, width):
        out = mix(out * U(0x5851F42D4C957F2D) + h[k:len(h) - width + 1 + k])
    return out


def matches(w: Words, items: Items, least: float) -> dict[int, dict[int, float]]:
    """Row of the slice -> item number -> best similarity of any of its windows."""
    out: dict[int, dict[int, float]] = {}
    for width, (value, item, offset) in items.by_width.items():
        h, row, first = w.shingles(width, short=False)
        a, b = np.searchsorted(value, h, "left"), np.searchsorted(value, h, "right")
        hit = np.flatnonzero(b > a)
        if not len(hit):
            continue
        n = (b - a)[hit]
        which = np.repeat(hit, n)
        at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a[hit], n)
        doc, pos, found = row[which], first[which], item[at]
        size = np.minimum(items.size[found], (w.at[1:] - w.at[:-1])[doc])
        # All windows of the item's size that cover the shared shingle.
        lo = np.maximum(pos + width - size, w.at[doc])
        hi = np.minimum(pos, w.at[doc + 1] - size)
        order = np.lexsort((lo, items.size[found], doc))
        bounds = np.flatnonzero(np.append(True, (np.diff(doc[order]) != 0) | (np.diff(items.size[found][order]) != 0)))
        for s, e in zip(bounds, np.append(bounds[1:], len(order)), strict=True):
            part = order[s:e]
            _windows(w, items, int(doc[part[0]]), int(items.size[found[part[0]]]), int(size[part[0]]), lo[part], hi[part], least, out)
    return out


def _windows(w: Words, items: Items, doc: int, full: int, size: int, lo: np.ndarray, hi: np.ndarray, least: float, out: dict) -> None:
    """Fingerprint the windows that start in the ranges and verify what the index finds."""
    own, index = items.index[full]
    at, last = 0, -1
    while at < len(lo):
        start, end = max(int(lo[at]), last + 1), int(hi[at])
        at += 1
        while at < len(lo) and lo[at] <= end + 1:
            end = max(end, int(hi[at]))
            at += 1
        for a in range(start, end + 1, RUN):
            starts = np.arange(a, min(a + RUN, end + 1))
            probe, near = index.near(simhash(w.hashes, size, starts))
            for p, i in zip(probe.tolist(), own[near].tolist(), strict=True):
                best = out.get(doc, {}).get(i, 0.0)
                if best < 1.0:
                    value = weighted_jaccard(_rolled(w.hashes[starts[p]:starts[p] + size], min(items.width, full, size)), items.shingles[i])
                    if value >= least and value > best:
                        out.setdefault(doc, {})[i] = value
        last = max(last, end)


def item_blocks(benchmark: DataFrame, key: str, text: str) -> list:
    """The items as broadcast blocks of at most about BLOCK_ITEMS items and BLOCK_BYTES bytes, made one after another."""
    spark = benchmark.sparkSession
    base = benchmark.filter(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.lower(F.col(text)).alias("text"))
    size = base.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    count = max(1, -(-size["n"] // BLOCK_ITEMS), -(-size["b"] // BLOCK_BYTES))
    out = []
    for k in range(count):
        rows = base.filter(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == k).orderBy("id", "text").collect()
        out.append((uuid.uuid4().hex, spark.sparkContext.broadcast(([r["id"] for r in rows], [r["text"] for r in rows]))))
    return out


def with_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
                 least: float = SIMILARITY, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """Every row with ``bench_items`` (ids of matching items, ascending) and ``bench_similarity`` (the best; 0.0 if none).

    An item matches when a window of as many words as the item (the whole text if that is shorter) reaches the weighted
    Jaccard similarity. A null or empty text, an item without words and an empty benchmark match nothing; items of fewer
    than ``width`` words are compared as one shingle. Items given twice are reported once. Columns of these two names
    are replaced; all others pass.
    """
    blocks = item_blocks(benchmark, item, item_text)
    rest = [c for c in docs.columns if c not in ("bench_items", "bench_similarity")]
    kind = benchmark.schema[item].dataType
    arrow = pa.int64() if isinstance(kind, T.LongType) else pa.int32() if isinstance(kind, T.IntegerType) else pa.string()
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField("bench_items", T.ArrayType(kind)), T.StructField("bench_similarity", T.DoubleType())])

    def block(name: str, b) -> Items:
        if name not in _BUILT:
            _BUILT.clear()  # one block in memory at a time
            _BUILT[name] = Items(*b.value, width, radius)
        return _BUILT[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[dict] = [{} for _ in range(batch.num_rows)]
            for name, b in blocks:
                items = block(name, b)
                if not items.ids:
                    continue
                for w in words(batch.column(batch.num_columns - 1)):
                    for row, got in matches(w, items, least).items():
                        for i, value in got.items():
                            who = items.ids[i]
                            found[w.first + row][who] = max(value, found[w.first + row].get(who, 0.0))
            ids = pa.array([sorted(f, key=lambda v: (v is not None, v)) for f in found], pa.list_(arrow))
            best = pa.array([max(f.values(), default=0.0) for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids, best], schema=pa.schema(
                [*list(batch.schema)[:-1], pa.field("bench_items", ids.type), pa.field("bench_similarity", best.type)]))

    return docs.select(*rest, F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("__folded")).transform(in_batches, run, schema)
