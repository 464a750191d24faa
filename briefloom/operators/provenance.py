"""Offsets, spans and source versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefloom import scale
from briefloom.functions import text as tx


def assign_offsets(segments: DataFrame, separator: int = 2) -> DataFrame:
    """start/end of each cleaned, non-empty segment in the joined text of its document.

    ``segments``: doc_id, seg_no, text. Documents of any length spread over chunks of consecutive segments.
    """
    kept = segments.filter(tx.has_content("text")).withColumn("text", tx.normalize_text("text"))
    # Measured before the rows move, so a caller that drops the text does not move it either. Empty segments count for a
    # document's size, so that counting does not clean.
    kept = kept.withColumn("__n", F.length("text"))
    placed = scale.running(kept, ["doc_id"], scale.position_chunk("seg_no"), ["seg_no"], {"start": F.col("__n") + F.lit(separator)},
                           large=scale.large_groups(segments, ["doc_id"]))
    return placed.withColumn("start", F.col("start").cast("long")).withColumn("end", F.col("start") + F.col("__n")).drop("__n")


def segment_arrays(docs: DataFrame) -> DataFrame:
    """Documents with ``pieces`` (an array of raw segment texts) to body text plus segments with offsets.

    The whole step stays inside the row: no shuffle.
    """
    cleaned = F.filter(F.transform("pieces", lambda t, i: F.struct((i + 1).cast("long").alias("seg_no"),
                                                                  tx.strip(t).alias("text"))),
                       lambda s: s["text"] != "")
    # Keep only the running end of the text; a segment starts its own length before it.
    ends = scale.scan(F.col("cleaned"), F.lit(-2), lambda at, s: at + 2 + F.length(s["text"]), lambda at: at,
                      "bigint", "bigint")
    rest = [c for c in docs.columns if c != "pieces"]
    return (docs.withColumn("cleaned", cleaned).withColumn("at", ends)
            .select(*rest, F.array_join(F.transform("cleaned", lambda s: s["text"]), "\n\n").alias("text"),
                    F.zip_with("cleaned", "at", lambda s, p: F.struct(
                        s["seg_no"].alias("seg_no"), s["text"].alias("text"),
                        (p - F.length(s["text"])).alias("start"), p.alias("end"))).alias("segs")))


def verify_offsets(docs: DataFrame) -> DataFrame:
    """Segments whose range is invalid or whose text is not what the range addresses."""
    n = F.length("text")

    def problem(s):
        bad = (s["start"] < 0) | (s["end"] > n) | (s["end"] <= s["start"])
        found = F.substr(F.col("text"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))
        return F.when(bad, "invalid_range").when(found != s["text"], "drift")

    marked = F.filter(F.transform("segs", lambda s: F.struct(s["seg_no"].alias("seg_no"),
                                                             problem(s).alias("problem"))),
                      lambda s: s["problem"].isNotNull())
    return docs.select("doc_id", F.explode(marked).alias("m")).select("doc_id", "m.seg_no", "m.problem")


def asset_span_problems(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Asset spans that end past their document. ``docs``: doc_id, char_count."""
    return spans.join(docs, "doc_id").filter(F.col("end") > F.col("char_count"))


def resolve_spans(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Each span with the whole text it cites.

    The join key is the document; adaptive execution splits a document that most spans cite.
    """
    quote = F.substr(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    return spans.join(docs, "doc_id").withColumn("quote", quote).drop("text")


def changed_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """Documents whose normalised text differs between two snapshots. Only digests are shuffled."""
    a = old.select("doc_id", tx.source_fingerprint("text").alias("old_sha"))
    b = new.select("doc_id", tx.source_fingerprint("text").alias("new_sha"))
    # Digests are never null. A plain inequality would have Spark look for nulls first: each text cleaned once more, before it is spread.
    return a.join(b, "doc_id").filter(~F.col("old_sha").eqNullSafe(F.col("new_sha")))
