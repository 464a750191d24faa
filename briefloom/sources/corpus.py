"""Deck tables projected from the star-schema and document tables.

Text decks: a source is a deck, a document a section, a line a slide, a sentence a block.
Numeric decks: a customer is a deck, an order priority a section, an order a slide, a line item a block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from briefloom import scale
from briefloom.functions import text as tx
from briefloom.session import tune


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return tune(spark).read.parquet(f"{folder}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use every core on input that arrives in fewer splits than there are cores; large inputs pass untouched."""
    want = df.sparkSession.sparkContext.defaultParallelism
    have = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if have >= want else df.repartition(want)


def pick(key: Column, values: list[str]) -> Column:
    """values[key] for a small fixed list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key + 1).cast("int"))


# ---------------------------------------------------------------- text decks


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(read(spark, folder, "documents").select("doc_id", F.col("source").alias("deck_uid"), "text"))


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """One row per line: slide_no from 1."""
    return (documents(spark, folder)
            .select("doc_id", "deck_uid", F.posexplode(F.split("text", "\n")).alias("p", "line"))
            .select("doc_id", "deck_uid", (F.col("p") + 1).cast("long").alias("slide_no"), "line"))


def sentence_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """One row per sentence: block_no from 1 within its line."""
    return (lines(spark, folder)
            .select("doc_id", "deck_uid", "slide_no", F.posexplode(tx.sentences("line")).alias("p", "content"))
            .select("doc_id", "deck_uid", "slide_no", (F.col("p") + 1).cast("long").alias("block_no"), "content"))


def plan_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their lines as typed segments, one row per document."""
    doc = F.col("doc_id")

    def seg(line: Column, p: Column) -> Column:
        i = (p + 1).cast("int")
        head, table, cap = i % 5 == 1, i % 7 == 4, i % 7 == 5
        t = tx.strip(line)
        kind = (F.when(head, "heading").when(table, "table").when(cap, "caption").when(i % 9 == 7, "equation")
                .when(i % 3 == 0, "list_item").otherwise("paragraph"))
        text = (F.when(cap & ~head, F.concat(F.lit("Table "), i, F.lit(": "), t)).otherwise(t))
        level = F.when(head, 1 + (F.floor(i / 5) + doc) % 3).otherwise(0).cast("int")
        asset = F.when(~head & table, F.concat(F.lit("tbl-"), i)).when(~head & cap, F.concat(F.lit("tbl-"), i - 1))
        return F.struct(i.cast("long").alias("seg_no"), kind.alias("kind"), text.alias("text"), level.alias("level"),
                        asset.alias("asset_id"))

    segs = F.filter(F.transform(F.split("text", "\n"), seg), lambda s: s["text"] != "")
    docs = documents(spark, folder).select("doc_id", "deck_uid", segs.alias("segs"))
    first = F.try_element_at("segs", F.lit(1))["text"]
    return docs.select("doc_id", "deck_uid", F.when(doc % 4 == 0, first).otherwise(
        F.concat(F.lit("Talk "), doc)).alias("title"), F.array(F.concat(F.lit("A"), doc)).alias("authors"), "segs")


# ------------------------------------------------------------- numeric decks


@dataclass(frozen=True)
class DeckTables:
    decks: DataFrame
    sections: DataFrame
    slides: DataFrame
    blocks: DataFrame
    assets: DataFrame
    sources: DataFrame


PRIORITY_RUBRICS = ["innovation", "methods", "objectives", "motivation", "schedule"]
DENSITIES = ["sparse", "balanced", "compact"]
DERIVATIONS = ["verbatim", "compressed", "synthesized", "inferred", "authored"]
ORIGINS = {"ECONOMY": "extracted", "SMALL": "redrawn", "MEDIUM": "authored", "PROMO": "generated",
           "STANDARD": "extracted", "LARGE": "redrawn"}


def _code(column: Column, mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[column]


def num_decks(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    return read(spark, folder, "customer").select(
        key.alias("deck_uid"), F.lit("grant_defense").alias("scenario"), F.lit("zh").alias("language"),
        (300 + 60 * (key % 10)).alias("total_seconds"), F.lit(210).alias("words_per_minute"),
        pick(key % 3, DENSITIES).alias("density"), F.lit(100).alias("reserve_milli"),
        F.lit(None).cast("double").alias("target_dwell_seconds"))


def _section_uid() -> Column:
    return F.concat_ws(":", F.col("o_custkey"), F.substring("o_orderpriority", 1, 1))


def num_slides(spark: SparkSession, folder: str) -> DataFrame:
    locked = F.col("o_orderkey") % 13 == 0
    n = F.substring("o_orderpriority", 1, 1).cast("int")
    return read(spark, folder, "orders").select(
        F.col("o_custkey").alias("deck_uid"), _section_uid().alias("section_uid"), n.alias("section_no"),
        F.element_at(F.array(*[F.lit(w) for w in (2000, 1600, 1400, 1200, 600)]), n).alias("weight_milli"),
        F.col("o_orderkey").alias("slide_uid"), F.col("o_orderkey").alias("slide_no"),
        _code(F.col("o_orderstatus"), {"F": "text_dense", "O": "text_figure", "P": "table"}).alias("role"),
        (F.col("o_orderkey") % 11 == 0).alias("is_backup"), locked.alias("dwell_locked"),
        F.when(locked, F.lit(20.0)).alias("dwell_seconds"))


def num_sections(spark: SparkSession, folder: str) -> DataFrame:
    n = F.substring("o_orderpriority", 1, 1).cast("int")
    return (read(spark, folder, "orders")
            .select(F.col("o_custkey").alias("deck_uid"), _section_uid().alias("section_uid"), n.alias("section_no"))
            .distinct()
            .withColumn("rubric_key", pick(F.col("section_no") - 1, PRIORITY_RUBRICS)))


POSITION = ("line_no", "part_key", "supp_key", "units", "price_cents")


def num_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return blocks_of(read(spark, folder, "lineitem"))


def _units() -> Column:
    return F.col("l_quantity").cast("int")


def _cents() -> Column:
    return F.round(F.col("l_extendedprice") * 100).cast("long")


def blocks_of(items: DataFrame, *more: str, units: Column | None = None, cents: Column | None = None) -> DataFrame:
    """Line items as blocks, and any other columns; stateless, so it serves tables and streams alike."""
    line, part, supp = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    units, cents = _units() if units is None else units, _cents() if cents is None else cents
    figure = part % 5 == 0
    span = F.struct(supp.alias("doc_id"), (line * 10).alias("start"), (line * 10 + units).alias("end"))
    again = F.struct(supp.alias("doc_id"), (line * 10 + 100).alias("start"),
                     (line * 10 + 100 + units).alias("end"))
    none = F.array().cast("array<struct<doc_id:bigint,start:int,end:int>>")
    return items.select(
        F.col("l_orderkey").alias("slide_uid"),
        F.concat_ws(".", "l_orderkey", line, part, supp, units, cents).alias("block_uid"),
        line.alias("line_no"), part.alias("part_key"), supp.alias("supp_key"), units.alias("units"),
        cents.alias("price_cents"),
        F.when(part % 10 == 0, "table").when(figure, "figure").otherwise("bullet").alias("type"),
        figure.alias("is_visual"),
        F.when(figure, part).alias("asset_ref"), (line % 4).alias("level"),
        pick(supp % 5, DERIVATIONS).alias("derivation"),
        F.round(F.col("l_discount") * 10000).cast("int").alias("importance_milli"),
        _code(F.col("l_returnflag"), {"A": "slide", "N": "script", "R": "drop"}).alias("channel"),
        (line == 1).alias("pinned"), F.lit(False).alias("channel_pinned"),
        (line % 2 == 0).alias("needs_confirmation"),
        F.when(part % 7 == 0, none).when(line == 2, F.array(span, again)).otherwise(F.array(span)).alias("spans"), *more)


def large_slides(spark: SparkSession, folder: str) -> DataFrame:
    """Slides of so many blocks that their numbering has to be cut into chunks."""
    return scale.large_groups(read(spark, folder, "lineitem"), ["l_orderkey"])


def numbered_blocks(blocks: DataFrame, large: DataFrame | None = None) -> DataFrame:
    """block_no: the position of each block on its slide."""
    chunk = {"__c1": F.col("line_no"), "__c2": F.floor(F.col("part_key") / 4096)}
    large = scale.large_groups(blocks, ["slide_uid"]) if large is None else large
    return scale.running(blocks, ["slide_uid"], chunk, list(POSITION), number="block_no", large=large)


def placed_blocks(spark: SparkSession, folder: str, large: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """The blocks with their position, numbered as line items: what a block says is written out behind the shuffle.

    ``only`` (slide_uid) names the slides whose blocks are wanted, each whole; ``large`` must then be written out, as it is looked into."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "__units", "__cents"]
    chunk = {"__c1": F.col("l_linenumber"), "__c2": F.floor(F.col("l_partkey") / 4096)}
    # Moved as the whole numbers that order and name a block, not beside the fractions they come from.
    items = read(spark, folder, "lineitem").withColumns({"__units": _units(), "__cents": _cents()}).drop("l_quantity", "l_extendedprice")
    if only is not None:
        items = items.join(only.select(F.col("slide_uid").alias("l_orderkey")), "l_orderkey", "left_semi")
    if only is not None and large is not None and large.isEmpty():
        placed = scale.running_whole(items, ["l_orderkey"], order, number="block_no")
    else:
        large = large_slides(spark, folder) if large is None else large
        placed = scale.running(items, ["l_orderkey"], chunk, order, number="block_no", large=large)
    return blocks_of(placed, "block_no", units=F.col("__units"), cents=F.col("__cents"))


def num_assets(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("p_partkey")
    return (read(spark, folder, "part").filter(F.col("p_size") <= 45)
            .select(key.alias("asset_uid"), F.lit("figure").alias("kind"),
                    _code(F.col("p_type"), ORIGINS).alias("origin"), (key % 7 != 0).alias("has_spans"),
                    F.col("p_name").alias("caption")))


def num_sources(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("s_suppkey")
    return (read(spark, folder, "supplier").filter(key % 20 != 0)
            .select(key.alias("doc_id"), (60 + key % 60).alias("char_count")))


def deck_tables(spark: SparkSession, folder: str) -> DeckTables:
    return DeckTables(num_decks(spark, folder), num_sections(spark, folder), num_slides(spark, folder),
                      num_blocks(spark, folder), num_assets(spark, folder), num_sources(spark, folder))


# --------------------------------------------------------------------- edits

EVENT_OPS = {"click": "set_importance", "view": "pin", "purchase": "set_channel", "error": "delete_block",
             "signup": "retime"}


def edits(spark: SparkSession, folder: str) -> DataFrame:
    """One column-only edit per event."""
    k = F.get_json_object("props", "$.k").cast("long")
    op = _code(F.col("event_type"), EVENT_OPS)
    value = (F.when(op == "set_importance", F.round(F.col("value") * 2).cast("long").cast("string"))
             .when(op == "pin", F.lit("true"))
             .when(op == "set_channel", pick(F.col("event_id") % 3, ["slide", "script", "drop"]))
             .when(op == "delete_block", F.lit("drop"))
             .otherwise((300 + F.col("event_id") % 600).cast("string")))
    return read(spark, folder, "events").select(
        F.col("user_id").alias("deck_uid"), F.col("event_id").alias("seq"), F.lit(1).alias("op_no"),
        F.col("event_id").alias("patch_id"), F.col("ts").cast("timestamp").alias("created_at"),
        op.alias("op"), k.alias("target"), value.alias("value"),
        (F.col("event_id") % 100).alias("confidence_pct"))


# ------------------------------------------------------- gestures and anchors


def anchors(spark: SparkSession, folder: str) -> DataFrame:
    """One anchor per block of the numeric decks: the blocks of a page share its height, pages count from 1 in their deck."""
    pages = num_slides(spark, folder).select("deck_uid", "slide_uid", "slide_no")
    pages = scale.running(pages, ["deck_uid"], scale.position_chunk("slide_no", 1 << 16), ["slide_no"], number="slide_index",
                          large=scale.large_groups(pages, ["deck_uid"])).drop("slide_no")
    blocks = placed_blocks(spark, folder)
    pages = pages.join(num_blocks(spark, folder).groupBy("slide_uid").agg(F.count(F.lit(1)).alias("n")), "slide_uid")
    part = lambda whole: F.expr(f"({whole}) DIV n") / F.lit(10000.0)
    y = part("1000 * n + 8500 * (block_no - 1)")
    return blocks.join(pages, "slide_uid").select(
        "deck_uid", "slide_index", F.col("block_uid").alias("uid"), F.when(F.col("type") == "figure", "figure").otherwise("block").alias("kind"),
        F.lit(0.05).alias("x"), y.alias("y"), F.lit(0.9).alias("w"), part("8000").alias("h"), F.lit(0.85).alias("confidence"))


def clicks(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, folder, "events").select(
        F.col("event_id").alias("gesture_id"), F.col("user_id").alias("deck_uid"),
        (1 + F.col("event_id") % 5).alias("slide_index"),
        ((F.col("event_id") % 97) / F.lit(97.0)).alias("px"), (k / F.lit(100.0)).alias("py"))
