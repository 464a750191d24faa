"""Rendered pages: text geometry, overflow, build logs, repair and anchor boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom import scale
from briefloom.functions import shapes as sh
from briefloom.functions import text as tx
from briefloom.operators import model as md

BOTTOM_LIMIT, RIGHT_LIMIT = 0.955, 0.97
LINE_SPACING = 1.22


def page_extent(words: DataFrame) -> DataFrame:
    """Lowest and rightmost text of each page and whether it runs over."""
    g = words.groupBy("file", "page").agg(
        F.max("page_w").alias("page_w"), F.max("page_h").alias("page_h"), F.count(F.lit(1)).alias("words"),
        F.max("y_max").alias("lowest"), F.max("x_max").alias("rightmost"))
    bottom = F.col("lowest") / F.col("page_h")
    right = F.col("rightmost") / F.col("page_w")
    return g.withColumn("overflows", (bottom > BOTTOM_LIMIT) | (right > RIGHT_LIMIT))


def page_overflow_rate(extent: DataFrame) -> DataFrame:
    return extent.groupBy("file").agg(F.count(F.lit(1)).alias("pages"), F.count_if("overflows").alias("over")) \
        .withColumn("rate", F.round(F.col("over") / F.col("pages"), 4))


def bbox_words(lines: DataFrame) -> DataFrame:
    """Page and word tags of bounding-box listings to word rows.

    ``lines``: file, line_no, text. A word belongs to the latest page tag before it; files are cut into chunks of
    lines, so one very long listing spreads over tasks.
    """
    num = r'([\d.]+)'
    page = rf'<page width="{num}" height="{num}"'
    word = rf'<word xMin="{num}" yMin="{num}" xMax="{num}" yMax="{num}"'
    is_page, is_word = F.col("text").rlike(page), F.col("text").rlike(word)
    t = lines.filter(is_page | is_word)
    chunk = scale.position_chunk("line_no")
    t = scale.running(t.withColumn("__p", F.col("text").rlike(page).cast("int")), ["file"], chunk, ["line_no"],
                      {"__before": F.col("__p")})
    size = F.when(F.col("__p") == 1, F.struct(F.regexp_extract("text", page, 1).cast("double").alias("w"),
                                              F.regexp_extract("text", page, 2).cast("double").alias("h")))
    t = scale.latest_before(t, ["file"], chunk, ["line_no"], {"__size": size})
    parts = [F.regexp_extract("text", word, i + 1).cast("double").alias(n)
             for i, n in enumerate(("x_min", "y_min", "x_max", "y_max"))]
    return t.filter("__p = 0 AND __size IS NOT NULL").select(
        "file", "line_no", F.col("__before").cast("long").alias("page"), F.col("__size.w").alias("page_w"),
        F.col("__size.h").alias("page_h"), *parts)


def scan_build_logs(lines: DataFrame) -> DataFrame:
    """Errors and box warnings of build logs; a repeated error keeps its first line."""
    t = tx.strip("text")
    located = r"^[^:]+:(\d+):\s*(.+)$"
    message = F.regexp_extract(t, located, 2)
    real = (t.rlike(located) & ~F.col("text").startswith("(")
            & (message.startswith("Undefined control sequence") | message.startswith("! ") | message.contains("Error")))
    bang = ~t.rlike(located) & F.col("text").startswith("! ") & ~F.col("text").contains("Rerun")
    box = r"^(Overfull|Underfull)\s+\\([hv])box\s+\(([^)]*)\)(.*)$"
    said = (F.when(real, F.concat(F.lit("line "), F.regexp_extract(t, located, 1), F.lit(": "), message))
            .when(bang, tx.strip(F.substr(F.col("text"), F.lit(3)))))
    errors = lines.withColumn("message", said).filter("message IS NOT NULL").groupBy("file", "message").agg(
        F.min("line_no").alias("line_no")).withColumn("kind", F.lit("error"))
    boxes = lines.filter(t.rlike(box)).select(
        "file", F.concat(F.regexp_extract(t, box, 1), F.lit(" \\"), F.regexp_extract(t, box, 2), F.lit("box ("),
                         F.regexp_extract(t, box, 3), F.lit(")")).alias("message"), "line_no", F.lit("box").alias("kind"))
    return errors.unionByName(boxes)


def visible_order(slides: DataFrame) -> DataFrame:
    """Adds page_no: content slides first, reserve last, within a deck."""
    chunk = {"__c1": F.col("is_backup").cast("int"), "__c2": F.col("section_no"),
             "__c3": F.floor(F.col("slide_no") / 65536)}
    return scale.running(slides, ["deck_uid"], chunk, ["is_backup", "section_no", "slide_no"], number="page_no")


def page_to_slide(pages: DataFrame, ordered: DataFrame) -> DataFrame:
    """Pages (deck_uid, page_no) with the slide printed on them."""
    return pages.join(ordered.select("deck_uid", "page_no", "slide_uid"), ["deck_uid", "page_no"])


def least_important(blocks: DataFrame, order: Column) -> DataFrame:
    """The block a repair moves from each slide: least important on the page, not visual, not pinned; first of equals."""
    movable = blocks.filter((F.col("channel") == "slide") & ~md.is_visual() & ~F.col("pinned"))
    return movable.groupBy("slide_uid").agg(
        F.min_by("block_uid", F.struct("importance_milli", order.alias("p"))).alias("block_uid"),
        F.count(F.lit(1)).alias("movable"))


def anchor_layout(blocks: DataFrame) -> DataFrame:
    """Box of each block inside its slot: stacked by wrapped line counts, offset by the slot's vertical anchor.

    ``blocks``: slide_uid, block_no, lines, font_size, slot_x, slot_y, slot_w, slot_h, anchor, page_w, page_h (points).
    """
    h = F.col("lines") * F.col("font_size") * LINE_SPACING
    micro = F.round(h * 10000).cast("long")
    b = blocks.withColumn("__h", micro)
    b = scale.running(b, ["slide_uid"], {"__c1": F.floor(F.col("block_no") / 512)}, ["block_no"], {"__top": F.col("__h")})
    b = scale.with_totals(b, ["slide_uid"], {"__all": F.sum("__h")})
    slack = F.greatest(F.lit(0.0), F.col("slot_h") - F.col("__all") / 10000)
    offset = F.when(F.col("anchor") == "middle", slack / 2).when(F.col("anchor") == "bottom", slack).otherwise(0.0)
    top = F.col("slot_y") + offset + F.col("__top") / 10000
    box = sh.page_box(F.col("slot_x"), top, F.col("slot_w"), F.col("__h") / 10000, F.col("page_w"), F.col("page_h"))
    return b.withColumn("box", box).filter("box IS NOT NULL").select("slide_uid", "block_no", "box.x", "box.y", "box.w", "box.h")


def slot_fits(measured: DataFrame) -> DataFrame:
    """Rendering summary per slide: slots over their box and slots set smaller than nominal.

    ``measured``: deck_uid, slide_uid, slot_id, nominal, size, ratio."""
    return measured.groupBy("deck_uid").agg(
        F.countDistinct("slide_uid").alias("slides"),
        F.countDistinct(F.when(F.col("ratio") > 1.0, F.col("slide_uid"))).alias("over"),
        F.count_if((F.col("size") < F.col("nominal")) & (F.col("ratio") <= 1.0)).alias("shrunk"))
