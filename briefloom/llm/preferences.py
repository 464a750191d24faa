"""Preference formatting: the common beginning of two conversations once as prompt, the rest as masked completions.

Turns stay rows all the way, so a conversation of any length is never gathered: positions and offsets are running sums
over chunks, and the common prefix is the first position at which the two sides differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from briefloom.llm.shared import cut_lineage
from briefloom.scale import running

CHUNK = 1024
BOUNDS = 255  # rows that cut the table into ranges, about equally many rows each
SHOWN = 100  # characters of text that a bound compares


def ranges(turns: DataFrame, order: list[str]) -> Column:
    """The number of bounds at or before a row; bounds are rows drawn at random, in ``order``.

    A conversation of any size is cut where its rows are, also if they share turn and role. Rows of one turn
    and role stay together only where their first ``SHOWN`` characters agree.
    """
    schema = StructType([f for n in order for f in turns.schema.fields if f.name == n])
    drawn = turns.select(*order[:-1], F.substring(order[-1], 1, SHOWN).alias(order[-1])).orderBy(F.rand(7)).limit(BOUNDS)
    size, written = drawn.agg(F.count(F.lit(1)), F.to_json(F.collect_list(F.struct(*order)))).first()
    if not size:
        return F.lit(0)
    # One literal, which the optimiser reads once: as many literals as bounds make plans slow.
    listed = F.sort_array(F.from_json(F.lit(written), ArrayType(schema)))
    row = F.struct(*order)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(size.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when((at + step <= size) & (F.get(listed, at + step - 1) <= row), step).otherwise(0))


def numbered(turns: DataFrame, key: str) -> DataFrame:
    """Turns with a position from 1 in order of turn, role and text (nulls first)."""
    base = turns.select(F.col(key).alias("pair"), F.coalesce(F.col("turn"), F.lit(-1)).cast("long").alias("turn"),
                        F.coalesce(F.col("role"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    order = ["turn", "role", "text"]
    return running(base, ["pair"], {"__chunk": ranges(base, ["pair", *order])}, order, number="position")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Segments of prompt, chosen and rejected from two tables (pair, position, role, text).

    One row per rendered turn: pair, part (``prompt``, ``chosen``, ``rejected``), position, role, rendered text, its
    offsets in the rendered part (code points), and ``train``, 1 for assistant turns of a completion: the loss mask.
    Turns are equal when role and text are. Equal conversations give a prompt and no completion; a pair known to one
    side only has no prompt. A null pair forms one conversation of its own per side and is not joined to anything else.
    """
    side = lambda df, name: df.select("pair", "position", "role", "text", F.lit(name).alias("side"))
    both = side(chosen, "chosen").unionByName(side(rejected, "rejected"))
    h = F.struct("role", "text")
    at = both.groupBy("pair", "position").agg(F.count_if(F.col("side") == "chosen").alias("c"), F.count_if(F.col("side") == "rejected").alias("r"),
                                              F.min(F.xxhash64(h)).alias("a"), F.max(F.xxhash64(h)).alias("b"),
                                              F.min(F.md5(F.concat_ws("\u0001", "role", "text"))).alias("d"),
                                              F.max(F.md5(F.concat_ws("\u0001", "role", "text"))).alias("e"))
    differs = (F.col("c") != F.col("r")) | (F.col("a") != F.col("b")) | (F.col("d") != F.col("e"))
    split = at.groupBy("pair").agg(F.min(F.when(differs, F.col("position"))).alias("split"))
    marked = both.join(split.select(F.col("pair").alias("__pair"), "split"), F.col("pair").eqNullSafe(F.col("__pair")), "left").drop("__pair")
    common = F.col("split").isNull() | (F.col("position") < F.col("split"))
    parts = (marked.withColumn("part", F.when(common, F.lit("prompt")).otherwise(F.col("side")))
             .filter(~(common & (F.col("side") == "rejected")))  # the prompt is rendered once
             .withColumn("rendered", rendered(F.col("role"), F.col("text")))
             .withColumn("length", F.length("rendered").cast("long"))
             .select("pair", "part", "position", "role", "rendered", "length"))
    placed = running(parts, ["pair", "part"], {"__chunk": F.floor(F.col("position") / CHUNK)}, ["position"], sums={"start": F.col("length")})
    return placed.select("pair", "part", "position", "role", "rendered", F.col("start").cast("long").alias("start"),
                         (F.col("start") + F.col("length")).cast("long").alias("end"),
                         F.when((F.col("part") != "prompt") & (F.col("role") == "assistant"), 1).otherwise(0).alias("train"))


def parroted(conversations: DataFrame, key: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """A preference pair per conversation: as it is up to its last assistant turn, and with that turn an echo.

    In the rejected version the last assistant turn repeats the turn before it (empty for a first turn). A
    conversation without assistant turns is kept whole on both sides.
    """
    turns = cut_lineage(numbered(conversations, key))  # read seven times below
    last = turns.filter(F.col("role") == "assistant").groupBy("pair").agg(F.max("position").alias("last"))
    kept = (turns.join(last.select(F.col("pair").alias("__pair"), "last"), F.col("pair").eqNullSafe(F.col("__pair")), "left").drop("__pair")
            .filter(F.col("last").isNull() | (F.col("position") <= F.col("last"))))
    final = kept.filter(F.col("position") == F.col("last")).select("pair", "position", "role")
    echo = kept.filter(F.col("position") == F.col("last") - 1).select(F.col("pair").alias("__pair"), F.col("text").alias("said"))
    replaced = (final.join(echo, F.col("pair").eqNullSafe(F.col("__pair")), "left")
                .select("pair", "position", "role", F.coalesce("said", F.lit("")).alias("text")))
    before = kept.filter(F.col("last").isNull() | (F.col("position") < F.col("last"))).select("pair", "position", "role", "text")
    return kept.select("pair", "position", "role", "text"), before.unionByName(replaced)
