"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exception phrases.

Folding maps homoglyphs to Latin letters and digit or symbol substitutions inside words back to letters, so hidden
spellings meet the same entries. An entry is a whole word or a word beginning; its weight is the log-odds of toxic
against clean documents. Entries are chosen by greedy cover: always the purest entry that explains the most toxic
documents not explained yet, so words that merely stand beside a slur, as in groups of copies, are not learned. The
score is a logistic function of summed weight and of weight per word.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.llm.shared import cut_lineage, in_batches

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
              "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
              "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
              "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ᴏ": "o"}
# Digits and symbols that stand for letters inside a word.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i",
               "|": "l", "+": "t"}
# Harmless phrases around words that may be entries.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "pond scum", "class clown")

SEPARATORS = str.maketrans(dict.fromkeys("​‌‍⁠﻿­", None))
GLYPHS = str.maketrans(HOMOGLYPHS)
DIGITS = str.maketrans(SUBSTITUTES)
MAX_TOXIC, MAX_CLEAN = 4000, 12000  # expected bounds of the labelled sample that the lexicon is learned from
SHORTEST, LONGEST = 4, 8  # letters of a learned word beginning
LEAST_ODDS = math.log(20.0)  # an entry is at least so much likelier in toxic rows; what exceeds it counts as purity


def _word(token: str) -> str:
    """A token with punctuation removed at its ends and substitutions undone inside; parts are split by blanks."""
    low = token.strip("!|+.,;:?\"'()[]{}<>*#%&_-/\\=~^`")
    if any(c.isalpha() for c in low):
        low = low.translate(DIGITS)
    return "".join(c if c.isalnum() else " " for c in low)


def fold(text: str) -> str:
    """Lower-case words between single blanks, with homoglyphs, accents of compatibility forms and substitutes folded."""
    low = text if text.isascii() else unicodedata.normalize("NFKC", text).translate(SEPARATORS)
    low = low.lower()
    if not low.isascii():
        low = low.translate(GLYPHS)
    return " " + " ".join(" ".join(w if w.isalpha() else _word(w) for w in low.split()).split()) + " "


def terms(folded: str) -> set[str]:
    """Entries the text could support: every word as a whole and its beginnings."""
    out = set()
    for w in set(folded.split()):
        if len(w) >= 3:
            out.add(f" {w} ")
            out.update(f" {w[:n]}" for n in range(SHORTEST, min(LONGEST, len(w) - 1) + 1))
    return out


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    scale: tuple[float, float, float] = (1.0, 0.5, -2.0)  # of summed weight, weight per word, constant
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "scale": self.scale, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                a.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                a.add_word(f" {' '.join(fold(phrase).split())} ", (len(phrase) + 2, None))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def features(self, text: str) -> tuple[float, float, int]:
        """Summed weight, weight per word, number of hits. A word that two entries match counts once, by the higher."""
        folded = fold(text)
        hits: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        if len(self.weights):
            for end, (length, weight) in self.automaton().iter(folded):
                start = end - length + 1
                if weight is None:
                    spared.append((start, end))
                else:
                    hits[start] = max(weight, hits.get(start, 0.0))
        spared.sort()
        total, count, at, reach = 0.0, 0, 0, -1
        for start in sorted(hits):
            while at < len(spared) and spared[at][0] <= start:
                reach = max(reach, spared[at][1])
                at += 1
            if start < reach:
                continue
            total += hits[start]
            count += 1
        words = folded.count(" ") - 1
        return math.log1p(total), math.log1p(100 * total / max(1, words)), count

    def score(self, text: str) -> tuple[float, int]:
        x, y, hits = self.features(text)
        z = self.scale[0] * x + self.scale[1] * y + self.scale[2]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), hits


def held_out(doc_id: Column) -> Column:
    """Whether the row belongs to the fifth that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, most_toxic: int = MAX_TOXIC, most_clean: int = MAX_CLEAN) -> DataFrame:
    """Labelled rows to learn from, chosen by a hash of the id: an expected ``most_toxic`` and ``most_clean`` rows.

    The ids chosen are few by these parameters, so they are broadcast and no text is shuffled.
    """
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {1: most_toxic / max(1, n.get(1, 0)), 0: most_clean / max(1, n.get(0, 0))}
    draw = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxicity")), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    chosen = known.filter(draw < F.when(F.col("toxic") == 1, F.lit(share[1])).otherwise(F.lit(share[0])))
    return docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull()).join(F.broadcast(chosen), "doc_id")


def _listed(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [sorted(terms(fold(t or ""))) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(found, pa.list_(pa.string()))], names=["toxic", "terms"])

    # Exact copies teach once.
    once = rows.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    return once.select("text", F.col("toxic").cast("int").alias("toxic")).transform(in_batches, run, "toxic int, terms array<string>")


def _cover(lists: Sequence[Sequence[str]], odds: dict[str, float], least: int) -> list[str]:
    """Entries that explain the lists, greedily; equal gains prefer the longer, then the alphabetical entry."""
    where: dict[str, set[int]] = {}
    for i, found in enumerate(lists):
        for t in found:
            where.setdefault(t, set()).add(i)
    chosen: list[str] = []
    while where:
        best = max(where, key=lambda t: (len(where[t]) * (odds[t] - LEAST_ODDS), len(t), t))
        got = where.pop(best)
        if len(got) < least:
            break
        chosen.append(best)
        where = {t: rest for t, s in where.items() if len(rest := s - got) >= least}
    return chosen


def _add_depth(lists: Sequence[Sequence[str]], odds: dict[str, float], least: int, rounds: int = 3) -> list[str]:
    """Several covers, each without the entries before it, so that entries that always stand beside others are found.

    Later covers need ten times the support, which words of a single group of copies do not reach.
    """
    out: list[str] = []
    left = [list(x) for x in lists]
    for k in range(rounds):
        got = _cover(left, odds, least if k == 0 else max(10 * least, len(lists) // 50))
        out += got
        stems = tuple(got)
        left = [[t for t in x if not any(t.startswith(s.rstrip(" ")) or s.startswith(t) for s in stems)] for x in left]
    return out


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; the last column of ``x`` is the constant."""
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (p - y)) / w.sum() + penalty @ beta
        curve = (x * (w * p * (1 - p))[:, None]).T @ x / w.sum() + penalty
        step = np.linalg.solve(curve, grad)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def learn(docs: DataFrame, labels: DataFrame, most_toxic: int = MAX_TOXIC, most_clean: int = MAX_CLEAN) -> Lexicon:
    """The lexicon and its calibration, from the labelled sample without the held-out fifth.

    Without any toxic label the lexicon is empty and every score is low. Term counts are grouped in Spark; the driver
    sees the entries that pass and, for the toxic rows of the sample, which of them each row has.
    """
    rows = sample(docs, labels, most_toxic, most_clean)
    listed = cut_lineage(_listed(rows))
    size = {r["toxic"]: r["n"] for r in listed.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic:
        return Lexicon({})
    least = max(2, toxic // 400)
    counted = (listed.select("toxic", F.explode("terms").alias("term")).groupBy("term")
               .agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
               .withColumn("odds", F.log(((F.col("t") + 0.1) / F.lit(toxic + 1.0)) / ((F.col("c") + 0.1) / F.lit(clean + 1.0))))
               .filter((F.col("t") >= least) & (F.col("odds") > LEAST_ODDS)))
    good = listed.filter("toxic = 1").withColumn("row", F.monotonically_increasing_id()).select("row", F.explode("terms").alias("term"))
    per_row = good.join(counted, "term").groupBy("row").agg(F.collect_list("term").alias("terms")).select("terms").collect()
    odds = {r["term"]: float(r["odds"]) for r in counted.select("term", "odds").collect()}
    chosen = _add_depth([sorted(r["terms"]) for r in per_row], odds, least)
    lexicon = Lexicon({t: odds[t] for t in chosen})
    lexicon.exceptions = tuple(dict.fromkeys((*EXCEPTIONS, *_learned_exceptions(rows, lexicon))))
    grid = _calibration(rows, lexicon)
    x = np.array([[r["x"], r["y"], 1.0] for r in grid])
    y, w = np.array([float(r["toxic"]) for r in grid]), np.array([float(r["n"]) for r in grid])
    lexicon.scale = tuple(float(b) for b in logistic(x, y, w, ridge=1e-4))
    return lexicon


def _learned_exceptions(rows: DataFrame, lexicon: Lexicon) -> list[str]:
    """Two-word phrases around an entry that clean rows of the sample use at least three times and toxic ones never."""
    stems = [e.rstrip(" ") for e in lexicon.weights]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folded = fold(text or "")
                if not any(s in folded for s in stems):
                    continue
                words = folded.split()
                pairs = {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)
                         if any(f" {a} ".startswith(e) or f" {b} ".startswith(e) for e in lexicon.weights)}
                found.update((p, toxic) for p in pairs)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int32()),
                                              pa.array(list(found.values()), pa.int64())], names=["phrase", "toxic", "n"])

    seen = rows.select("text", F.col("toxic").cast("int").alias("toxic")).transform(in_batches, run, "phrase string, toxic int, n long")
    return [r["phrase"] for r in seen.groupBy("phrase").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"),
                                                             F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
            .filter("t = 0 AND c >= 3").orderBy("phrase").collect()]  # bounded by the sample, of which each takes three texts at least


def _calibration(rows: DataFrame, lexicon: Lexicon):
    """The sample's features on a grid of hundredths, with counts: bounded by the sample."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [lexicon.features(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([round(g[0], 2) for g in got], pa.float64()),
                                              pa.array([round(g[1], 2) for g in got], pa.float64())], names=["toxic", "x", "y"])

    return (rows.select("text", F.col("toxic").cast("int").alias("toxic")).transform(in_batches, run, "toxic int, x double, y double")
            .groupBy("toxic", "x", "y").agg(F.count(F.lit(1)).alias("n")).collect())


def score(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with ``score`` (0 to 1), ``predicted`` and the number of ``hits``; a null text scores as empty.

    Rows with equal or null keys are scored one by one; only the key and the results are returned.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [lexicon.score(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([int(g[0] >= 0.5) for g in got], pa.int32()),
                 pa.array([g[1] for g in got], pa.int64())], names=[key, "score", "predicted", "hits"])

    return (docs.select(F.col(key), F.col(text).cast("string").alias("__text"))
            .transform(in_batches, run, f"`{key}` {kind}, score double, predicted int, hits long"))
