"""Quality classifier: overlapping heuristic labellers, their accuracies by expectation-maximisation, a hashed scorer.

Each labeller votes good, bad or nothing on a text. Votes of all texts are counted per pattern of votes, of which there
are at most ``3 ** len(LABELLERS)``; expectation-maximisation on these counts estimates how each labeller votes on good
and on bad texts and the share of bad ones. The posterior of a pattern is the weak label of its texts. A linear scorer
over hashed words and hashed levels of surface statistics learns them from a bounded sample and scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from briefloom.llm.arrays import FACTOR, U, Words, counted, mix, words
from briefloom.llm.shared import in_batches

BUCKETS = 1 << 16
SAMPLE = 8000  # expected rows that the scorer is fitted on
LABELLERS = ("symbols", "capitals", "bars", "repeats", "exclaims", "variety", "dominance", "sentences", "clusters", "loose")
GOOD, BAD, NONE = 1, 2, 0
LEVELS = 12
CLASSES = np.zeros(256, dtype=np.uint8)  # 1 lower, 2 upper, 3 digit, 4 blank, 5 other ASCII, 6 beyond ASCII
CLASSES[[*range(33, 127)]] = 5
CLASSES[97:123], CLASSES[65:91], CLASSES[48:58], CLASSES[[9, 10, 13, 32]], CLASSES[128:] = 1, 2, 3, 4, 6


def statistics(w: Words) -> np.ndarray:
    """Per row the values that the labellers judge, in their order, and the number of words last."""
    kinds = CLASSES[w.data]
    row = np.repeat(np.arange(w.rows), np.diff(w.offsets))
    per = np.bincount(row * 7 + kinds, minlength=7 * w.rows).reshape(w.rows, 7).astype(np.float64)
    count = lambda c: np.bincount(row[w.data == ord(c)], minlength=w.rows).astype(np.float64)
    n = np.diff(w.at).astype(np.float64)
    some = np.maximum(n, 1)
    owner = w.row_of()
    again = (w.hashes[1:] == w.hashes[:-1]) & (owner[1:] == owner[:-1]) if len(w.hashes) else np.empty(0, bool)
    repeats = np.bincount(owner[1:][again], minlength=w.rows)
    _, whose, times = counted(w.hashes, owner)
    distinct = np.bincount(whose, minlength=w.rows)
    top = np.zeros(w.rows)
    np.maximum.at(top, whose, times)
    ends = count(".") + count("?")
    visible = np.maximum(per[:, [1, 2, 3, 5, 6]].sum(axis=1), 1)
    letters = np.maximum(per[:, [1, 2]].sum(axis=1), 1)
    other, blank = (kinds == 5) & (w.data != ord(".")), kinds == 4
    inner = row[1:-1] if len(row) > 2 else row[:0]
    clusters = np.bincount(inner[(other[:-2] & other[1:-1] & other[2:])], minlength=w.rows) if len(row) > 2 else np.zeros(w.rows)
    loose = np.bincount(inner[(blank[:-2] & other[1:-1] & blank[2:])], minlength=w.rows) if len(row) > 2 else np.zeros(w.rows)
    # Long texts repeat words anyway, so variety is judged against the square root of the length.
    return np.stack([per[:, 5] / visible, per[:, 2] / letters, count("|") / some, repeats / some, count("!") / some,
                     distinct / np.sqrt(some), top / some, n / np.maximum(ends, 1), clusters / some, loose / some, n], axis=1)


def votes(s: np.ndarray) -> np.ndarray:
    """Rows x labellers: GOOD, BAD or NONE."""
    n = s[:, -1]
    rule = lambda bad, good: np.where(bad, BAD, np.where(good, GOOD, NONE))
    few = lambda k, least: n * s[:, k] >= least
    return np.stack([
        rule((s[:, 0] > 0.15) & (n >= 10), s[:, 0] < 0.1), rule((s[:, 1] > 0.5) & (n >= 5), s[:, 1] < 0.3),
        rule((s[:, 2] > 0.1) & few(2, 2), s[:, 2] < 0.02), rule((s[:, 3] > 0.3) & (n >= 5), s[:, 3] < 0.1),
        rule((s[:, 4] > 0.2) & few(4, 3), s[:, 4] < 0.05), rule((s[:, 5] < 2.5) & (n >= 60), s[:, 5] > 4),
        rule((s[:, 6] > 0.25) & (n >= 30), s[:, 6] < 0.15), rule((s[:, 7] > 200) & (n >= 200), (s[:, 7] < 60) & (n >= 5)),
        rule((s[:, 8] > 0.2) & few(8, 3), s[:, 8] < 0.05), rule((s[:, 9] > 0.1) & few(9, 2), s[:, 9] < 0.03)], axis=1).astype(np.int8)


def features(w: Words, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse features: (row, bucket, value). Words share one unit of length; each statistic's level counts one."""
    h, row, n = counted(w.hashes, w.row_of())
    norm = np.sqrt(np.bincount(row, n.astype(np.float64) ** 2, minlength=w.rows))
    bucket = (mix(h) % U(BUCKETS)).astype(np.int64)
    value = 0.5 * n / np.maximum(norm[row], 1e-9)
    edges = np.array([0.005, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 1, 3])
    k = len(LABELLERS)
    scaled = s[:, :k] / np.array([1, 1, 1, 1, 1, 10, 1, 400, 1, 1])
    level = np.searchsorted(edges, scaled, "right")
    named = (mix((np.arange(k, dtype=U) * U(LEVELS) + level.astype(U)) ^ U(FACTOR)) % U(BUCKETS)).astype(np.int64)
    return (np.concatenate([row, np.repeat(np.arange(w.rows), k)]), np.concatenate([bucket, named.reshape(-1)]),
            np.concatenate([value, np.ones(k * w.rows)]))


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Share of bad texts and P(vote | labeller, class, it votes) as an array (labellers, 2 classes, 3 votes).

    Starts from "bad if any labeller says so". No vote says nothing, so its column is 1. Counts are smoothed, so no
    labeller is ever certain.
    """
    k = patterns.shape[1]
    bad = np.where((patterns == BAD).any(axis=1), 0.9, 0.02)
    share, table = 0.1, np.full((k, 2, 3), 1 / 3)
    for _ in range(rounds):
        before = bad
        share = float(np.clip((bad * counts).sum() / max(counts.sum(), 1), 0.001, 0.999))
        for c, weight in ((0, (1 - bad) * counts), (1, bad * counts)):
            for v in (GOOD, BAD):
                table[:, c, v] = ((patterns == v) * weight[:, None]).sum(axis=0) + 0.5
        table[:, :, 1:] /= table[:, :, 1:].sum(axis=2, keepdims=True)
        table[:, :, NONE] = 1.0
        bad = posterior(patterns, share, table)
        if np.abs(bad - before).max() < 1e-9:
            break
    return share, table


def posterior(patterns: np.ndarray, share: float, table: np.ndarray) -> np.ndarray:
    """Probability of bad, labellers taken as independent given the class."""
    which = np.arange(patterns.shape[1])
    logs = np.log(table[which, :, patterns]).sum(axis=1) + np.log([1 - share, share])
    return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))


@dataclass
class Model:
    weights: np.ndarray
    constant: float
    share_bad: float
    table: np.ndarray  # what is known of each labeller


def _coded(v: np.ndarray) -> np.ndarray:
    return v.astype(np.int64) @ (3 ** np.arange(v.shape[1]))


def _decoded(code: np.ndarray) -> np.ndarray:
    return (code[:, None] // 3 ** np.arange(len(LABELLERS)) % 3).astype(np.int8)


def _folded(docs: DataFrame, text: str):
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def vote_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(code of the vote pattern, number of texts) over all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(0), lower=True):
                code, n = np.unique(_coded(votes(statistics(w))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

    return docs.select(_folded(docs, text)).transform(in_batches, run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, text: str = "text", most: int = SAMPLE) -> Model:
    """Reliabilities from all texts, and the scorer from an expected ``most`` of them, chosen by a hash of the text.

    Exact copies fall in or out of the sample together, so they are weighed by their group once. An empty table gives a
    scorer that keeps everything.
    """
    found = vote_counts(docs, text).collect()
    if not found:
        return Model(np.zeros(BUCKETS, np.float32), 5.0, 0.0, np.full((len(LABELLERS), 2, 3), 1 / 3))
    codes, counts = np.array([r["code"] for r in found]), np.array([r["n"] for r in found], dtype=np.float64)
    share, table = reliabilities(_decoded(codes), counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(1), lower=True):
                s = statistics(w)
                row, bucket, value = features(w, s)
                order = np.argsort(row, kind="stable")
                at = np.searchsorted(row[order], np.arange(w.rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(w.first, w.rows), pa.array(_coded(votes(s))), pa.ListArray.from_arrays(pa.array(at), pa.array(bucket[order].astype(np.int32))),
                     pa.ListArray.from_arrays(pa.array(at), pa.array(value[order].astype(np.float32)))], names=["h", "code", "buckets", "values"])

    draw = F.pmod(F.xxhash64(F.col("text"), F.lit("quality")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = (docs.select(_folded(docs, text).alias("text")).filter(draw < most / counts.sum())
            .select(F.xxhash64("text").alias("h"), "text").transform(in_batches, run, "h long, code long, buckets array<int>, values array<float>")
            .groupBy("h").agg(F.first("code").alias("code"), F.first("buckets").alias("buckets"), F.first("values").alias("values"))
            .orderBy("h").toArrow())
    if rows.num_rows == 0:
        return Model(np.zeros(BUCKETS, np.float32), 5.0, share, table)
    good = 1 - posterior(_decoded(rows["code"].to_numpy()), share, table)
    lists, numbers = rows["buckets"].combine_chunks(), rows["values"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    weights, constant = fit(np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy(), numbers.flatten().to_numpy(), good)
    return Model(weights, constant, share, table)


def fit(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, y: np.ndarray, steps: int = 150, rate: float = 0.5,
        ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by full-batch adaptive gradient steps; both classes weigh the same."""
    n, g, b = len(y), np.zeros(BUCKETS), float(np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3)))
    seen, seen_b = np.full(BUCKETS, 1e-8), 1e-8
    weight = np.where(y >= 0.5, 0.5 / max((y >= 0.5).sum(), 1), 0.5 / max((y < 0.5).sum(), 1))
    weight = 0.5 * weight + 0.5 / n  # between balanced and as found
    for _ in range(steps):
        z = np.bincount(row, value * g[bucket], minlength=n) + b
        off = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.bincount(bucket, value * off[row], minlength=BUCKETS) + ridge * g
        seen += grad * grad
        g -= rate * grad / np.sqrt(seen)
        seen_b += off.sum() ** 2
        b -= rate * off.sum() / np.sqrt(seen_b)
    return g.astype(np.float32), b


def with_quality(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row with ``quality_score`` (0 to 1, higher: better), ``weak_label`` (posterior of good) and ``kept`` (score >= 0.5).

    A null text is judged as empty, on its level features alone. Columns of these names are replaced, all others pass;
    equal texts have equal scores.
    """
    new = [("quality_score", T.DoubleType()), ("weak_label", T.DoubleType()), ("kept", T.BooleanType())]
    rest = [c for c in docs.columns if c not in dict(new)]
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField(c, t) for c, t in new])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats: of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            score, label = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for w in words(batch.column(batch.num_columns - 1), lower=True):
                s = statistics(w)
                row, bucket, value = features(w, s)
                z = np.bincount(row, value * m.weights[bucket], minlength=w.rows) + m.constant
                score[w.first:w.first + w.rows] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                label[w.first:w.first + w.rows] = 1 - posterior(votes(s), m.share_bad, m.table)
            more = [pa.array(score), pa.array(label), pa.array(score >= 0.5)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], schema=pa.schema(
                [*list(batch.schema)[:-1], *(pa.field(c, a.type) for (c, _), a in zip(new, more, strict=True))]))

    return docs.select(*rest, _folded(docs, text).alias("__text")).transform(in_batches, run, schema)
