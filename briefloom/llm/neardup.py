"""Near-duplicates by DartMinHash signatures, banded joining and exact verification.

Weighted Jaccard similarity over five-word shingles, the weight being the number of occurrences. Each unit of weight is
a region of its own; darts are thrown into a region as a Poisson process over rank, all darts of a document up to a
rank that yields about ``k ln k + 2k`` of them, so the work per document does not depend on the number of coordinates
times its length. Every coordinate keeps its earliest dart; a document with an empty coordinate throws up to twice the
rank. Two documents agree in a coordinate with probability equal to their similarity.

Joining: copies of the same words collapse to one node first. In every band bucket members meet only the bucket's
centre (the node that meets most others in all its buckets); links are verified on the whole texts. Members of a bucket
that the verified links leave in different components then meet each other, so no candidate link between different
components is left unseen, and a group of thousands of copies costs links in proportion to its members. Exact bounds
spare pairs that cannot be similar. At similarity s two texts share s / (1 + s) of their total weight, and

* no more than either's weight in shingles that occur in an open text of another component at all;
* with all shingles in one order, rarest first, the first one they share has little of either text before it: at most
  1 - s of the larger and 1 - 2 s / (1 + s) of the smaller. If it is one of the shingles of at most ``RARE`` texts, both
  texts have it there; if not, all they share is frequent, so they share no more than either's weight in such.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from briefloom.llm.arrays import FACTOR, SLICE, U, counted, mix, words
from briefloom.llm.shared import cut_lineage, discard, in_batches

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 5  # a pair at 0.8 is missed with probability (1 - 0.8**5)**32 = 3e-6
RARE = 16  # texts that hold a shingle; decides which of two exact bounds is tried, never the result
NOTHING = np.uint64(0xFFFFFFFFFFFFFFFF)


def dart_minhash(cells: np.ndarray, row: np.ndarray, weight: np.ndarray, rows: int, k: int) -> np.ndarray:
    """Signatures (rows x k): per coordinate rank (upper half) and name (lower half) of the earliest dart.

    ``cells`` are element hashes with integer ``weight`` in ``row``. Rows without elements keep NOTHING everywhere.
    """
    which = np.repeat(np.arange(len(cells)), weight)
    unit = np.arange(len(which)) - np.repeat(np.cumsum(weight) - weight, weight)
    region = mix(cells[which] + unit.astype(U) * U(0xD1342543DE82EF95))
    owner = row[which]
    total = np.bincount(owner, minlength=rows)
    limit = (k * math.log(k) + 2 * k) / np.maximum(total, 1)
    best = np.full(rows * k, NOTHING, dtype=U)
    number = np.zeros(len(region), dtype=np.int64)

    def gap(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dart = mix(region[i] + number[i].astype(U) * U(FACTOR))
        return dart, -np.log(((dart >> U(11)) + U(1)).astype(np.float64) * 2.0**-53)

    name, rank = gap(np.arange(len(region)))
    todo = np.arange(len(region))
    while len(todo):
        active = todo[rank[todo] <= limit[owner[todo]]]
        while len(active):
            other = mix(name[active] ^ U(0xA0761D6478BD642F))
            slot = owner[active] * k + (other % U(k)).astype(np.int64)
            key = (rank[active].astype(np.float32).view(np.uint32).astype(U) << U(32)) | (other >> U(32))
            np.minimum.at(best, slot, key)
            number[active] += 1
            name[active], more = gap(active)
            rank[active] += more
            active = active[rank[active] <= limit[owner[active]]]
        open_rows = (best.reshape(rows, k) == NOTHING).any(axis=1) & (total > 0)
        limit[open_rows] *= 2
        todo = np.flatnonzero(open_rows[owner])
    return best.reshape(rows, k)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band, different between bands."""
    part = signatures.reshape(len(signatures), bands, rows)
    h = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U)), part.shape[:2]).copy()
    for i in range(rows):
        h = mix(h * U(FACTOR) + part[:, :, i])
    return h


def signed(docs: DataFrame, key: str, text: str, bands: int, rows: int, width: int) -> DataFrame:
    """Per row: key, a hash of key and text, the node (hash of the words in order) and the band keys."""
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(2)):
                h, row, _ = w.shingles(width)
                cells, owner, n = counted(h, row)
                keys = band_keys(dart_minhash(cells, owner, n, w.rows, bands * rows), bands, rows)
                some = np.diff(w.at) > 0
                ends = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)
                part = batch.slice(w.first, w.rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(w.whole().view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].reshape(-1).view(np.int64)))],
                    names=["key", "rowkey", "node", "bands"])

    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    schema = T.StructType([T.StructField("key", kind), T.StructField("rowkey", T.LongType()), T.StructField("node", T.LongType()),
                           T.StructField("bands", T.ArrayType(T.LongType()))])
    return (docs.select(F.col(key).alias("key"), F.xxhash64(F.col(key), value).alias("rowkey"), F.lower(value).alias("text"))
            .transform(in_batches, run, schema))


def similar(pairs: DataFrame, least: float, width: int) -> DataFrame:
    """Pairs (a, b, text_a, text_b) whose texts reach the similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            value = np.zeros(n)
            size = np.cumsum(pc.add(pc.binary_length(batch.column(2)), pc.binary_length(batch.column(3))).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < n:  # pairs of about SLICE bytes at a time
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE, "right")))
                turns = np.arange(2 * (end - at)).reshape(2, end - at).T.reshape(-1)  # a0, b0, a1, b1, ...
                both = pa.concat_arrays([batch.column(2).slice(at, end - at), batch.column(3).slice(at, end - at)]).take(pa.array(turns))
                for part in words(both, step=2):
                    h, row, _ = part.shingles(width)
                    pair = row // 2
                    same = mix(h + pair.astype(U) * U(FACTOR))
                    order = np.argsort(same)
                    same = same[order]
                    if not len(same):
                        continue
                    start = np.flatnonzero(np.append(True, same[1:] != same[:-1]))
                    left = np.add.reduceat((row[order] % 2 == 0).astype(np.int64), start)
                    right = np.add.reduceat((row[order] % 2 == 1).astype(np.int64), start)
                    where = pair[order[start]]
                    low = np.bincount(where, np.minimum(left, right), minlength=part.rows // 2)
                    high = np.bincount(where, np.maximum(left, right), minlength=part.rows // 2)
                    first = at + part.first // 2
                    value[first:first + part.rows // 2] = low / np.maximum(high, 1)
                at = end
            good = pa.array(value >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])

    return pairs.select("a", "b", "text_a", "text_b").transform(in_batches, run, "a long, b long")


def weighed(texts: DataFrame, width: int) -> DataFrame:
    """(node, component, cell, weight): the shingles of each text, and one row per text with its total under no cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, component = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for w in words(batch.column(2)):
                h, row, _ = w.shingles(width)
                cells, owner, n = counted(h, row)
                part = slice(w.first, w.first + w.rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([node[part][owner], node[part]])), pa.array(np.concatenate([component[part][owner], component[part]])),
                     pa.array(np.concatenate([cells.view(np.int64), node[part]]), mask=np.repeat([False, True], [len(cells), w.rows])),
                     pa.array(np.concatenate([n, np.bincount(row, minlength=w.rows)]))], names=["node", "component", "cell", "weight"])

    return texts.select("node", "component", "text").transform(in_batches, run, "node long, component long, cell long, weight long")


def profiles(texts: DataFrame, width: int, least: float) -> DataFrame:
    """Per text the weights and shingles of the bounds; only shingles that a text of another component has count.

    ``size`` is the weight of all shingles, ``common`` of those that count, ``often`` of those among them that more than
    ``RARE`` texts have. ``early`` and ``first`` are the others that stand where the first shared shingle of the larger
    and of the smaller of two similar texts can stand. Texts that share nothing have no row.
    """
    rows = cut_lineage(weighed(texts, width))
    met = (rows.filter("cell IS NOT NULL").groupBy("cell").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("texts"))
           .filter("lo <> hi").select("cell", "texts"))
    size = rows.filter("cell IS NULL").select("node", F.col("weight").alias("size"))
    placed = (rows.select("node", "cell", "weight").join(met, "cell").join(size, "node")
              .withColumn("common", F.sum("weight").over(Window.partitionBy("node")))
              .withColumn("upto", F.sum("weight").over(Window.partitionBy("node").orderBy("texts", "cell"))))
    before = F.col("size") - F.col("common") + F.col("upto") - F.col("weight")
    stands = lambda share: F.when((F.col("texts") <= RARE) & (before <= F.col("size") * share + 1e-6), F.col("cell"))
    out = cut_lineage(placed.groupBy("node", "size", "common").agg(
        F.sum(F.when(F.col("texts") > RARE, F.col("weight")).otherwise(0)).alias("often"),
        F.collect_list(stands(1 - least)).alias("early"), F.collect_list(stands((1 - least) / (1 + least))).alias("first")))
    discard(rows)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; the component is its least node.

    Least labels spread along the edges and labels are replaced by their labels' labels, until nothing changes. All
    steps are joins on nodes; nothing is collected.
    """
    both = cut_lineage(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")))
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("component").alias("seen")))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "seen").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        moved, before = cut_lineage(step.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("root", "component")).alias("component"))), labels
        discard(before)
        labels = moved.select("node", "component")
        if moved.filter("component <> old").isEmpty():
            discard(both)
            return labels


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY, width: int = WIDTH,
                bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: its key, ``rowkey``, ``class_id``, ``class_size`` and ``keep``.

    A class is a component of the links of similarity ``least`` or more; its id is the least key in it (null only if
    all are). ``keep`` marks the row with the least key and text hash; rows that repeat key and text are kept together
    and told apart by nobody, so a caller drops repeats of ``rowkey``. A null text counts as empty; texts without words
    are alike only when they are equal. A text of fewer than five words has one shingle of all of them. Equality of
    words is judged by a 64-bit hash.
    """
    rowset = cut_lineage(signed(docs, key, text, bands, rows, width))
    nodes = cut_lineage(rowset.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "rowkey")).alias("rep"),
                                                   F.first("bands").alias("bands")))
    buckets = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    several = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    meeting = cut_lineage(buckets.join(several, "bucket"))
    reach = meeting.groupBy("node").agg(F.sum("c").alias("reach"))
    centres = (meeting.join(reach, "node").groupBy("bucket").agg(F.max(F.struct("reach", "n", "node")).alias("top"))
               .select("bucket", F.col("top.node").alias("centre")))
    shared = cut_lineage(meeting.select("bucket", "node").join(centres, "bucket"))
    discard(meeting)
    needed = shared.select("node").distinct().join(nodes.select("node", F.col("rep.rowkey").alias("rowkey")), "node")
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = cut_lineage(docs.select(F.xxhash64(F.col(key), value).alias("rowkey"), F.lower(value).alias("text")).join(needed, "rowkey")
                        .select("node", "text").dropDuplicates(["node"]))

    def verified(pairs: DataFrame) -> DataFrame:
        first = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        second = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        return similar(pairs.join(first, "a").join(second, "b"), least, width)

    star = cut_lineage(shared.filter("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct())
    links = cut_lineage(verified(star))
    labels = components(links)
    coloured = shared.join(labels, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    mixed = lambda df: df.join(df.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
                               .filter("lo <> hi").select("bucket"), "bucket")
    open_ = cut_lineage(mixed(coloured))
    able = open_
    for _ in range(2):  # what the first bound sets aside no longer counts in the second
        profile = profiles(able.select("node", "component").distinct().join(texts, "node"), width, least).filter(F.col("common") >= F.col("size") * least)
        able = cut_lineage(mixed(able.select("bucket", "node", "component").join(profile.select("node"), "node")))
    side = able.join(profile, "node").join(nodes.select("node", "bands"), "node")
    named_as = lambda x: side.select("bucket", *[F.col(c).alias(f"{c}_{x}") for c in side.columns if c != "bucket"])
    one, two = named_as("a"), named_as("b").withColumnRenamed("bucket", "bucket_b")
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    enough = lambda c: F.least(f"{c}_a", f"{c}_b") * (1 + least) >= (F.col("size_a") + F.col("size_b")) * least - 1e-6
    rarely = F.when(F.col("size_a") <= F.col("size_b"), F.arrays_overlap("first_a", "early_b")).otherwise(F.arrays_overlap("early_a", "first_b"))
    # A pair comes from the first bucket it shares, so it comes once.
    once = F.get(F.array_intersect("bands_a", "bands_b"), F.lit(0)) == F.col("bucket")
    met = (one.join(two, (F.col("bucket") == F.col("bucket_b")) & (F.col("component_a") < F.col("component_b")) & enough("size") & enough("common")
                    & (enough("often") | rarely) & once).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
    rest = ordered(met).join(ordered(star), ["a", "b"], "left_anti")
    more = cut_lineage(verified(rest))
    final = components(links.unionAll(more))
    discard(shared, texts, star, links, labels, open_, able, profile, more)
    named = nodes.join(final, "node", "left").select("node", "n", "rep", F.coalesce("component", "node").alias("component"))
    groups = named.groupBy("component").agg(F.min("rep").alias("rep"), F.min("rep.key").alias("class_id"), F.sum("n").alias("class_size"))
    result = named.select("node", "component").join(groups, "component").select("node", "rep", "class_id", "class_size")
    return (rowset.select("key", "rowkey", "node").join(result, "node")
            .select(F.col("key").alias(key), "rowkey", "class_id", "class_size", (F.col("rowkey") == F.col("rep.rowkey")).alias("keep")))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row of each class of near-duplicates, with the columns of ``docs``."""
    winners = near_groups(docs, key, text, **how).filter("keep").select(F.col("rowkey").alias("__rowkey")).distinct()
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return (docs.withColumn("__rowkey", F.xxhash64(F.col(key), value)).join(winners, "__rowkey").dropDuplicates(["__rowkey"])
            .select(*docs.columns))
