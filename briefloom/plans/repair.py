"""Repairing pages that run over."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.operators import model as md
from briefloom.operators import pages as pg
from briefloom.session import cut_lineage

MAX_ROUNDS = 3


def over_by_units(limit: Column) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A measure: pages whose printed units exceed ``limit``. ``limit`` may name columns of the slides."""
    def measure(slides: DataFrame, blocks: DataFrame) -> DataFrame:
        used = blocks.filter((F.col("channel") == "slide") & ~md.is_visual()).groupBy("slide_uid").agg(F.sum("units").alias("used"))
        return slides.join(used, "slide_uid").filter(F.col("used") > limit).select("deck_uid", "page_no")
    measure.reads = ("slide_uid", "channel", "type", "units")
    return measure


def _moved(blocks: DataFrame, hit: DataFrame) -> DataFrame:
    hit = hit.select("block_uid", F.lit(True).alias("__hit"))
    return (blocks.join(hit, "block_uid", "left").withColumn("channel", F.when(F.col("__hit"), "script").otherwise(F.col("channel")))
            .withColumn("channel_pinned", F.coalesce("__hit", "channel_pinned")).drop("__hit"))


def _given(blocks: DataFrame, victims: DataFrame) -> DataFrame:
    """The blocks of the pages that gave one, after that; a page listed more than once counts its block as often."""
    gave = victims.groupBy("slide_uid", F.col("block_uid").alias("__gave")).agg(F.count(F.lit(1)).cast("int").alias("__n"))
    hit = F.coalesce(F.col("block_uid") == F.col("__gave"), F.lit(False))
    out = blocks.join(gave, "slide_uid").withColumn("__n", F.explode(F.array_repeat(F.lit(0), F.when(hit, F.col("__n")).otherwise(1))))
    changed = {"channel": F.when(hit, "script").otherwise(F.col("channel")), "channel_pinned": hit | F.col("channel_pinned")}
    return out.withColumns({k: v for k, v in changed.items() if k in blocks.columns}).select(*blocks.columns)


def overflow_repair(slides: DataFrame, blocks: DataFrame, order: Column, measure: Callable[[DataFrame, DataFrame], DataFrame],
                    reallocate: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
                    rounds: int = MAX_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(blocks, moves): every overflowing page gives its least important block to the script, round by round.

    A moved block's channel is pinned, so a later allocation cannot put it back. The loop ends when nothing overflows or
    nothing can move. ``measure`` judges a page by its slide and blocks, so without ``reallocate`` a round looks only at the pages
    that gave a block in the one before, written to the checkpoint folder; where the measure names the block columns it
    ``reads``, with these and what the choice of a block needs. With ``reallocate`` each round writes all blocks.
    """
    ordered = cut_lineage(pg.visible_order(slides))
    reads = getattr(measure, "reads", None)
    at = blocks if reallocate else blocks.withColumn("__order", order)
    if reads and not reallocate:
        at = at.select(*dict.fromkeys([*reads, "slide_uid", "block_uid", "channel", "type", "pinned", "importance_milli", "__order"]))
    rank = order if reallocate else F.col("__order")
    moves = None
    for n in range(1, rounds + 1):
        over = measure(ordered, at)
        victims = cut_lineage(pg.page_to_slide(over, ordered).join(pg.least_important(at, rank), "slide_uid").select(
            "deck_uid", "page_no", "slide_uid", "block_uid", F.lit(n).alias("round")))
        if victims.isEmpty():
            break
        if reallocate:
            blocks = at = cut_lineage(reallocate(ordered, _moved(blocks, victims)))
        else:
            blocks = _moved(blocks, victims)
            at = cut_lineage(_given(at, victims)) if n < rounds else at
        moves = victims if moves is None else moves.unionByName(victims)
    return blocks, moves if moves is not None else ordered.select("deck_uid", "page_no", "slide_uid").limit(0)
