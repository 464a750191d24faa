"""Extracted lines to typed segments with exact offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefloom import scale
from briefloom.functions import lines as ln
from briefloom.operators import planning as pl
from briefloom.operators import provenance as pv
from briefloom.operators import structure as st
from briefloom.session import cut_lineage, discard


def segment_documents(lines: DataFrame) -> DataFrame:
    """``lines`` (doc_id, page, line_no, text, size, bold) to segments: doc_id, seg_no, kind, level, page, text, start, end.

    Lines are repaired and classed, joined into paragraphs, cut into list items, and placed in the joined text; entries
    under a references heading are marked as such.
    """
    # The body size and the chunk helpers read their input twice, so a line is cut and cleaned once and written, and long
    # chains of helpers are cut where the rows are few.
    clean = cut_lineage(lines.withColumn("text", ln.tighten_marks(ln.collapse_spaced_runs(ln.repair_ligatures("text")))).select(
        "doc_id", "page", "line_no", "text", "size", "bold"))
    marked = cut_lineage(st.line_kinds(clean).select("doc_id", "page", "line_no", "text", "heading_level"))
    discard(clean)
    paragraphs = cut_lineage(st.paragraphs(st.lines_to_paragraphs(marked)))
    discard(marked)
    head = F.col("heading_level") > 0
    text = F.when(head, ln.strip_number(F.col("text"))).otherwise(F.col("text"))
    kind = F.when(head, "heading").otherwise(ln.classify_block("text"))
    p = paragraphs.withColumn("kind", kind).withColumn("text", text)
    listed = F.col("kind").isin("paragraph", "list_item")
    pieces = F.when(listed, ln.split_inline_items("text")).otherwise(F.array("text"))
    cut = p.withColumn("__n", F.size(pieces)).select("*", F.posexplode(pieces).alias("__k", "__piece"))
    cut = cut.withColumn("kind", F.when(F.col("__n") > 1, "list_item").otherwise(F.col("kind"))).withColumn("text", F.col("__piece"))
    numbered = scale.running(cut, ["doc_id"], scale.position_chunk("par_no"), ["par_no", "__k"], number="seg_no")
    numbered = cut_lineage(numbered.select("doc_id", "page", "heading_level", "kind", "text", "seg_no"))
    discard(paragraphs)
    zoned = pl.reference_zone(numbered)
    kinds = F.when(F.col("in_references"), "reference").otherwise(F.col("kind"))
    out = zoned.withColumn("kind", kinds).withColumn("level", F.col("heading_level"))
    out = cut_lineage(out.select("doc_id", "seg_no", "kind", "level", "page", "text"))
    discard(numbered)
    return pv.assign_offsets(out)
