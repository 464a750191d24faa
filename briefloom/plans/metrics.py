"""One row of headline numbers per deck."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefloom.operators import budget as bg
from briefloom.operators import model as md


def run_metrics(decks: DataFrame, slides: DataFrame, blocks: DataFrame) -> DataFrame:
    """Units available, slides wanted and present, and how the spoken text fits the clock."""
    budget = bg.deck_budget(decks).select("deck_uid", "total_units", "target_slides")
    fit = bg.estimate_duration(decks, slides, blocks).select("deck_uid", "fit")
    counts = md.slide_counts(slides).select("deck_uid", F.col("content_slides").alias("actual_slides"))
    return budget.join(fit, "deck_uid").join(counts, "deck_uid", "left").fillna(0, ["actual_slides"])
