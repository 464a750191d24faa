"""The trie of conversation prefixes by a splitter skeleton.

A node is a sequence of turns from the beginning; its id is a hash of the turns with their positions, made from
running sums, so a conversation of any length is hashed in pieces. A node with one member is finished as it stands.
What remains of a conversation is its shared path, the ids of the nodes that others go through as well. Equal paths
collapse to one row with counts, and the distinct paths are dealt to sorted shards by splitter paths.

A node lies in more than one shard only if it is a prefix of a splitter. The splitters are broadcast; their prefixes are
the skeleton. A shard walks its paths in order with a stack and finishes every other node. Of a skeleton node it emits
what it has seen of it, and a sum over shards finishes the node: members, local children, leaves and saved tokens add
up, because the share that is not linear (one member is not saved, skeleton children count once) is a constant of the
skeleton.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefloom.llm.preferences import ranges
from briefloom.llm.shared import cut_lineage, discard, in_batches
from briefloom.scale import position_chunk, running

SHARD = 1 << 14  # path elements a shard is meant to have
SPLITTERS, SKELETON = 4096, 1 << 18  # at most so many splitters, with so many elements in all
DRAWN = 32  # sampled paths per splitter
FAMILY, HEADS = 100, 6  # conversations that share a beginning, and the bound of its length
CHUNK = 1024
NOTHING = hashlib.sha256(b"").hexdigest()


def numbered(conversations: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, position, d, n): turns in order, the digest of role and text, and the code points of the text."""
    said, who = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text, role))
    base = (conversations.filter(F.col(key).isNotNull())
            .select(F.col(key).cast("long").alias("conv"), F.col(turn).alias("turn"),
                    F.substring(F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, said), 256), 1, 32).alias("d"),
                    F.length(said).cast("long").alias("n")))
    base = cut_lineage(base)
    order = [F.asc_nulls_first("turn"), F.asc("d")]
    out = cut_lineage(running(base, ["conv"], {"__chunk": ranges(base, ["conv", "turn", "d"])}, order, number="position").select("conv", "position", "d", "n"))
    discard(base)
    return out


def rebuilt(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as the first of their family: (conv, total) and (conv, depth, d, n, last).

    The first ``h`` turns come from conversation ``conv - conv % family`` (all if it has fewer, none if there is none), the
    rest are the conversation's own after its first ``h``; ``h`` is the CRC-32 of the decimal id modulo ``heads``.
    """
    own = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own"))
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(heads))
    at = own.withColumn("h", h).withColumn("base", F.col("conv") - F.col("conv") % F.lit(family))
    there = own.select(F.col("conv").alias("base"), F.col("own").alias("there"))
    convs = cut_lineage(at.join(there, "base", "left").withColumn("shift", F.least("h", F.coalesce("there", F.lit(0))))
                        .withColumn("total", F.col("shift") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).select("conv", "base", "h", "shift", "total"))
    first = turns.filter((F.col("position") < heads) & (F.col("conv") % F.lit(family) == 0)).select(F.col("conv").alias("base"), F.col("position").alias("depth"), "d", "n")
    begun = convs.join(first, "base").filter(F.col("depth") <= F.col("h")).select("conv", "depth", "d", "n", "total")
    rest = (turns.join(convs, "conv").filter(F.col("position") > F.col("h"))
            .select("conv", (F.col("shift") + F.col("position") - F.col("h")).alias("depth"), "d", "n", "total"))
    return convs.select("conv", "total"), begun.unionByName(rest).select("conv", F.col("depth").cast("long").alias("depth"), "d", "n", (F.col("depth") == F.col("total")).alias("last"))


def with_nodes(paths: DataFrame) -> DataFrame:
    """``paths`` with ``node`` and ``parent``, ids of the sequences up to and before a turn (the root's is empty)."""
    pieces = {}
    for i in (0, 1):
        h = F.xxhash64(F.lit(i), F.col("depth"), F.col("d"))
        pieces |= {f"s{2 * i}": F.shiftrightunsigned(h, 32), f"s{2 * i + 1}": h.bitwiseAND(F.lit(0xFFFFFFFF))}
    base = cut_lineage(paths.withColumns(pieces))
    summed = running(base, ["conv"], position_chunk("depth", CHUNK), ["depth"], sums={f"p{s[1]}": F.col(s) for s in pieces})
    name = lambda sums, depth: F.md5(F.concat_ws(",", *[s.cast("string") for s in sums], depth.cast("string")))
    before = [F.col(f"p{s[1]}") for s in pieces]
    node = name([b + F.col(s) for b, s in zip(before, pieces, strict=True)], F.col("depth"))
    parent = F.when(F.col("depth") == 1, F.lit("")).otherwise(name(before, F.col("depth") - 1))
    out = cut_lineage(summed.select("conv", "depth", "n", "last", node.alias("node"), parent.alias("parent")))
    discard(base)
    return out


def splitters(paths: DataFrame, shard: int, most: int = SPLITTERS, elements: int = SKELETON) -> list[list[tuple[str, int]]]:
    """Sorted splitter paths (node, n) that cut ``paths`` into shards of about ``shard`` elements; a bounded sample decides."""
    total = paths.agg(F.coalesce(F.sum(F.size("path")), F.lit(0))).first()[0]
    count = min(most, -(-total // shard)) - 1
    if count < 1:
        return []
    deep = max(1, elements // (count * DRAWN))
    drawn = paths.select(F.slice("path", 1, deep).alias("path")).filter(F.size("path") > 0).orderBy(F.rand(17)).limit(count * DRAWN).collect()
    sample = sorted([(x["node"], x["n"]) for x in r["path"]] for r in drawn)
    # Cuts at equal shares of the sample's elements.
    share, seen, out = sum(map(len, sample)) / (count + 1), 0, []
    for path in sample:
        seen += len(path)
        if seen >= share * (len(out) + 1) and len(out) < count and (not out or out[-1] != path):
            out.append(path)
    return out


class Skeleton:
    """All prefixes of the splitters: per node how many children in the skeleton, and the code points of its subtree there."""

    def __init__(self, paths: list[list[tuple[str, int]]]):
        self.keys = ["".join(x for x, _ in p) for p in paths]
        self.children: dict[str, int] = {"": 0}
        self.points: dict[str, int] = {"": 0}
        for path in paths:
            above = [""]
            for node, n in path:
                if node not in self.children:
                    self.children[node] = self.points[node] = 0
                    self.children[above[-1]] += 1
                    for x in [*above, node]:
                        self.points[x] += n
                above.append(node)

    def shard(self, key: str) -> int:
        """Splitters at or before the path of this key."""
        return bisect_right(self.keys, key)


NAMES = ("node", "parent", "depth", "skeleton", "conv", "n_convs", "n_children", "n_leaves", "saved", "more", "less")
OUT = pa.schema([("node", pa.string()), ("parent", pa.string()), ("depth", pa.int64()), ("skeleton", pa.bool_()), *((n, pa.int64()) for n in NAMES[4:])])


def walk(rows: list[tuple], skeleton: Skeleton) -> list[tuple]:
    """The nodes of a shard's paths, as rows of ``OUT``: all of a local node, this shard's part of a skeleton node.

    ``rows`` are (key, path, members, tails, least member), sorted by key; a tail is a member that goes on alone.
    ``more`` and ``less`` are the skeleton's constants, to be added to children and taken from saved.
    """
    out: list[tuple] = []
    # An open node: id, n, least member, members, children, leaves, saved.
    stack: list[list] = [["", 0, None, 0, 0, 0, 0]]

    def close() -> None:
        node, n, least, members, children, leaves, saved = stack.pop()
        inside = node in skeleton.children
        if not children and not (inside and skeleton.children[node]):
            leaves = 1
        saved += n * (members if inside else members - 1)
        depth = len(stack)
        parent = stack[-1] if stack else None
        out.append((node, parent[0] if parent else None, depth, inside, least, members, children, leaves, saved,
                    skeleton.children[node] if inside else 0, skeleton.points[node] if inside else 0))
        if parent:
            parent[2] = least if parent[2] is None else min(parent[2], least)
            parent[3] += members
            parent[4] += not inside
            parent[5] += leaves
            parent[6] += saved

    for _, path, members, tails, least in rows:
        same = 0
        while same < len(path) and same + 1 < len(stack) and stack[same + 1][0] == path[same][0]:
            same += 1
        while len(stack) > same + 1:
            close()
        stack += [[node, n, None, 0, 0, 0, 0] for node, n in path[same:]]
        end = stack[-1]
        end[2] = least if end[2] is None else min(end[2], least)
        end[3] += members
        end[4] += tails
        end[5] += tails
    while stack:
        close()
    return out


def shared_nodes(paths: DataFrame, shard: int) -> DataFrame:
    """The nodes on ``paths`` (path, members, tails, least), the root among them; one row per node."""
    skeleton = Skeleton(splitters(paths, shard))
    held = paths.sparkSession.sparkContext.broadcast(skeleton)  # at most SKELETON elements

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = [held.value.shard(k) for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *batch.columns], names=["shard", *batch.schema.names])

    def finish(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["key"].to_pylist(), (list(zip(a, b, strict=True)) for a, b in zip(table["nodes"].to_pylist(), table["points"].to_pylist(), strict=True)),
                          *(table[c].to_pylist() for c in ("members", "tails", "least")), strict=True))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*walk(rows, held.value), strict=True), OUT.types, strict=True)], schema=OUT)

    flat = paths.select(F.array_join("path.node", "").alias("key"), F.col("path.node").alias("nodes"), F.col("path.n").alias("points"), "members", "tails", "least")
    dealt = flat.transform(in_batches, deal, "shard int, key string, nodes array<string>, points array<long>, members long, tails long, least long")
    seen = cut_lineage(dealt.groupBy("shard").applyInArrow(finish, "node string, parent string, depth long, skeleton boolean, " + ", ".join(f"{n} long" for n in NAMES[4:])))
    whole = seen.filter("skeleton").groupBy("node", "parent", "depth").agg(
        F.min("conv").alias("conv"), F.sum("n_convs").alias("n_convs"), (F.sum("n_children") + F.max("more")).alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), (F.sum("saved") - F.max("less")).alias("saved"))
    return seen.filter("NOT skeleton").select(*whole.columns).unionByName(whole)


def ended(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv): the digest of the ids in ascending order, joined by commas.

    The ids of a node stream through one hash in order, which is sequential by definition; only the hash is held.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for node, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest is None or node != now:
                    if digest is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = node, hashlib.sha256(str(conv).encode())
                else:
                    digest.update(b",%d" % conv)
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], names=["node", "ends_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])

    return ends.repartition("node").sortWithinPartitions("node", "conv").select("node", "conv").transform(in_batches, run, "node string, ends_sha256 string")


def trie(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
         shard: int = SHARD, rebuild=rebuilt) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    ``conv_id`` (least member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``. Turns are ordered by ``turn`` (null first), ties by a digest of role and text;
    repeated turns count as often as they stand there. A null role or text is empty. Rows without a conversation id
    belong to no conversation and are left out. Texts are hashed whole. An empty table has no node, not even a root.
    Other columns play no part. A shared path is held in one row, 50 bytes a turn; what a conversation does not share is never gathered.
    """
    convs, paths = rebuild(numbered(conversations, key, turn, role, text))
    rows = with_nodes(paths)
    stats = cut_lineage(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv"), F.max("depth").alias("depth"),
                                                 F.max("parent").alias("parent"), F.max("last").alias("last")))
    common = stats.filter("n_convs > 1").select("node")
    along = rows.join(common, "node", "left_semi").groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("depth", "node", "n"))).alias("path"))
    each = cut_lineage(convs.join(along, "conv", "left").withColumn("path", F.coalesce("path", F.array().cast("array<struct<depth:long,node:string,n:long>>")))
                       .withColumn("alone", F.col("total") > F.size("path")))
    distinct = cut_lineage(each.groupBy(F.transform("path", lambda x: F.struct(x["node"].alias("node"), x["n"].alias("n"))).alias("path"))
                           .agg(F.count(F.lit(1)).alias("members"), F.count_if("alone").alias("tails"), F.min("conv").alias("least")))
    tree = shared_nodes(distinct, shard)
    stops = ended(each.filter("NOT alone").select(F.coalesce(F.try_element_at("path", F.lit(-1))["node"], F.lit("")).alias("node"), "conv"))
    inner = tree.join(stops, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
    own = F.sha2(F.when(F.col("last"), F.col("conv").cast("string")).otherwise(F.lit("")), 256)
    outer = stats.filter("n_convs = 1").select("node", "parent", "depth", "conv", "n_convs", F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"),
                                              F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved"), own.alias("ends_sha256"))
    every = inner.unionByName(outer)
    above = tree.select(F.col("node").alias("parent"), F.col("conv").alias("above"))
    return every.join(above, "parent", "left").select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.coalesce("above", "conv")).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")
