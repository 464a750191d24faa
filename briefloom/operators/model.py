"""Projections, filters and joins over the deck tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from briefloom import scale
from briefloom.functions import text as tx

# Closed sets of the data model.
NON_CONTENT = ("metadata", "reference", "footnote", "caption")
NAVIGATION_ROLES = ("cover", "agenda", "section", "acknowledgement")
VISUAL_TYPES = ("figure", "table")
UID_PREFIX = {"deck": "dck", "section": "sec", "slide": "sld", "block": "blk", "asset": "ast"}
BLOCK_TYPES = ("bullet", "figure", "table", "equation", "code", "quote", "note", "caption")
CHANNELS = ("slide", "script", "drop")
ROLES = ("cover", "agenda", "section", "text_dense", "text_figure", "big_figure", "two_column", "three_column",
         "table", "equation", "timeline", "summary", "acknowledgement", "backup")
DERIVATIONS = ("verbatim", "compressed", "synthesized", "inferred", "authored")
ORIGINS = ("extracted", "redrawn", "authored", "generated")


def on_channel(blocks: DataFrame, channel: str) -> DataFrame:
    return blocks.filter(F.col("channel") == channel)


def content_segments(segments: DataFrame) -> DataFrame:
    return segments.filter(~F.col("kind").isin(*NON_CONTENT))


def headings(segments: DataFrame) -> DataFrame:
    return segments.filter(F.col("kind") == "heading")


def is_visual(type_col: Column | str = "type") -> Column:
    return tx.col(type_col).isin(*VISUAL_TYPES)


def is_spoken_only(channel_col: Column | str = "channel") -> Column:
    return tx.col(channel_col) == "script"


def is_navigation(role_col: Column | str = "role") -> Column:
    return tx.col(role_col).isin(*NAVIGATION_ROLES)


def content_slides(slides: DataFrame) -> DataFrame:
    return slides.filter(~F.col("is_backup") & ~is_navigation())


def navigation_slides(slides: DataFrame) -> DataFrame:
    return slides.filter(is_navigation())


def slide_counts(slides: DataFrame) -> DataFrame:
    """Slides, content slides and navigation slides per deck."""
    return slides.groupBy("deck_uid").agg(
        F.count(F.lit(1)).alias("slides"),
        F.count_if(~F.col("is_backup") & ~is_navigation()).alias("content_slides"),
        F.count_if(is_navigation()).alias("navigation_slides"))


def slide_paths(sections: DataFrame, slides: DataFrame) -> DataFrame:
    """Slides with ``s{i}.p{j}`` from their position."""
    numbered = scale.running(sections.select("deck_uid", "section_uid", "section_no"), ["deck_uid"],
                             scale.position_chunk("section_no"), ["section_no", "section_uid"], number="__i")
    placed = scale.running(slides, ["deck_uid", "section_uid"], scale.position_chunk("slide_no", 65536),
                           ["slide_no", "slide_uid"], number="__j")
    path = F.concat(F.lit("s"), F.col("__i"), F.lit(".p"), F.col("__j"))
    return (placed.join(numbered.select("deck_uid", "section_uid", "__i"), ["deck_uid", "section_uid"])
            .withColumn("path", path).drop("__i", "__j"))


def block_paths(slides_with_path: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks (with ``block_no``) with ``s{i}.p{j}.b{k}``."""
    return blocks.join(slides_with_path.select("slide_uid", "path"), "slide_uid").withColumn(
        "path", F.concat("path", F.lit(".b"), F.col("block_no")))


def flatten_deck(sections: DataFrame, slides: DataFrame, blocks: DataFrame) -> DataFrame:
    """(section, slide, block) rows with their ordinals; readers sort by them."""
    return (blocks.join(slides.select("deck_uid", "section_uid", "section_no", "slide_uid", "slide_no"), "slide_uid")
            .join(sections.select("deck_uid", "section_uid", "rubric_key"), ["deck_uid", "section_uid"], "left"))


def all_nodes(**tables: DataFrame) -> DataFrame:
    """Every node of every kind: deck_uid (null where shared), kind, uid."""
    out = None
    for kind, df in tables.items():
        deck = F.col("deck_uid").cast("string") if "deck_uid" in df.columns else F.lit(None).cast("string")
        part = df.select(deck.alias("deck_uid"), F.lit(kind).alias("kind"), F.col("uid").cast("string").alias("uid"))
        out = part if out is None else out.unionByName(part)
    return out


def find(nodes: DataFrame, uids: DataFrame) -> DataFrame:
    """The nodes of any kind named by ``uids.uid``."""
    return nodes.join(uids.select("uid").distinct(), "uid", "left_semi")


def mint_uid(kind: str, *keys: Column | str) -> Column:
    """Prefix and 12 hex digits from the kind and the keys; the same input gives the same uid on every retry."""
    digest = F.sha2(F.concat_ws(":", F.lit(kind), *[tx.col(k).cast("string") for k in keys]), 256)
    return F.concat(F.lit(UID_PREFIX[kind] + "_"), F.substring(digest, 1, 12))


def with_assets(blocks: DataFrame, assets: DataFrame) -> DataFrame:
    """Blocks with the asset they show. Blocks without one never enter the join key, so no null key gathers rows."""
    named = blocks.filter(F.col("asset_ref").isNotNull())
    found = named.join(assets.withColumnRenamed("asset_uid", "asset_ref"), "asset_ref", "left")
    return found.unionByName(blocks.filter(F.col("asset_ref").isNull()), allowMissingColumns=True)


def ancestors(slides: DataFrame, blocks: DataFrame) -> DataFrame:
    """(uid, ancestor) pairs: block to slide, section and deck; slide to section and deck."""
    def text(c: str) -> Column:
        return F.col(c).cast("string")

    up = slides.select("slide_uid", text("slide_uid").alias("a1"), text("section_uid").alias("a2"),
                       text("deck_uid").alias("a3"))
    of_blocks = blocks.select("slide_uid", F.col("block_uid").alias("uid")).join(up, "slide_uid").select(
        "uid", F.explode(F.array("a1", "a2", "a3")).alias("ancestor"))
    of_slides = up.select(F.col("a1").alias("uid"), F.explode(F.array("a2", "a3")).alias("ancestor"))
    return of_blocks.unionByName(of_slides)


def _violations(df: DataFrame, uid: str, rules: Mapping[str, Column]) -> DataFrame:
    names = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return df.select(F.col(uid).cast("string").alias("uid"), F.explode(names).alias("rule"))


def block_violations(blocks: DataFrame) -> DataFrame:
    """Shape rules of single blocks, one row per broken rule."""
    t = F.col("type")
    return _violations(blocks, "block_uid", {
        "visual_needs_asset": t.isin(*VISUAL_TYPES) & F.col("asset_ref").isNull(),
        "equation_needs_body": (t == "equation") & (F.coalesce("content", F.lit("")) == "")
                               & F.col("asset_ref").isNull(),
        "caption_needs_target": (t == "caption") & F.col("bound_to").isNull(),
        "note_on_slide": (t == "note") & (F.col("channel") == "slide"),
        "level_range": ~F.col("level").between(0, 3),
        "importance_range": ~F.col("importance_milli").between(0, 1000),
        "span_order": F.exists("spans", lambda s: s["end"] <= s["start"]),
        "unknown_type": ~t.isin(*BLOCK_TYPES),
        "unknown_channel": ~F.col("channel").isin(*CHANNELS),
    })


def caption_targets_elsewhere(blocks: DataFrame) -> DataFrame:
    """Captions whose target is not on the same slide."""
    caps = blocks.filter((F.col("type") == "caption") & F.col("bound_to").isNotNull())
    here = blocks.select("slide_uid", F.col("block_uid").alias("bound_to"))
    return caps.join(here, ["slide_uid", "bound_to"], "left_anti").select(
        F.col("block_uid").alias("uid"), F.lit("caption_target_elsewhere").alias("rule"))


def deck_violations(decks: DataFrame) -> DataFrame:
    return _violations(decks, "deck_uid", {
        "reserve_range": ~F.col("reserve_milli").between(0, 899),
        "seconds_positive": F.col("total_seconds") <= 0,
        "rate_positive": F.col("words_per_minute") <= 0,
    })


def uid_violations(nodes: DataFrame) -> DataFrame:
    return _violations(nodes, "uid", {"uid_pattern": ~F.col("uid").rlike("^[a-z]{3}_[0-9a-f]{12}$")})


def box_violations(boxes: DataFrame, uid: str) -> DataFrame:
    inside = (F.col("x").between(0, 1) & F.col("y").between(0, 1) & (F.col("w") > 0) & (F.col("h") > 0)
              & (F.col("w") <= 1) & (F.col("h") <= 1))
    return _violations(boxes, uid, {"box_outside_page": ~inside})


def asset_violations(assets: DataFrame) -> DataFrame:
    """An equation asset needs its source or a picture; any other a file or data."""
    equation = F.col("kind") == "equation"
    return _violations(assets, "asset_uid", {
        "equation_asset_payload": equation & F.col("latex").isNull() & F.col("path").isNull(),
        "asset_payload": ~equation & F.col("path").isNull() & F.col("data").isNull(),
    })


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def schema_rows(schema: T.StructType, prefix: str = "") -> list[tuple[str, str, bool]]:
    out = []
    for f in schema.fields:
        name = prefix + f.name
        inner = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        if isinstance(inner, T.StructType):
            out.append((name, "array" if isinstance(f.dataType, T.ArrayType) else "struct", not f.nullable))
            out.extend(schema_rows(inner, name + "."))
        else:
            out.append((name, f.dataType.simpleString(), not f.nullable))
    return out


def schema_drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """Fields that differ between two table contracts: missing on a side, other type, other nullability."""
    spark = a.sparkSession
    names = ("field", "type", "required")
    left = scale.fixed_table(spark, names, schema_rows(a.schema)).alias("l")
    right = scale.fixed_table(spark, names, schema_rows(b.schema)).alias("r")
    kind = (F.when(F.col("r.field").isNull(), "removed").when(F.col("l.field").isNull(), "added")
            .when(F.col("l.type") != F.col("r.type"), "type").when(F.col("l.required") != F.col("r.required"),
                                                                    "required"))
    return (left.join(right, F.col("l.field") == F.col("r.field"), "full_outer")
            .select(F.coalesce("l.field", "r.field").alias("field"), kind.alias("drift"),
                    F.col("l.type").alias("before"), F.col("r.type").alias("after")).filter("drift IS NOT NULL"))


def enum_drift(df: DataFrame, declared: Mapping[str, Sequence[str]]) -> DataFrame:
    """Values found against the declared members of closed-set columns: (field, member, drift)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("member")) for f in declared]))
    found = df.select(pairs.alias("p")).select("p.*").filter("member IS NOT NULL").distinct()
    known = scale.fixed_table(df.sparkSession, ("field", "member"), [(f, m) for f, ms in declared.items() for m in ms])
    return (found.withColumn("seen", F.lit(True))
            .join(known.withColumn("known", F.lit(True)), ["field", "member"], "full_outer")
            .select("field", "member", F.when(F.col("known").isNull(), "undeclared")
                    .when(F.col("seen").isNull(), "unused").alias("drift")).filter("drift IS NOT NULL"))


def document_metadata(docs: DataFrame) -> DataFrame:
    """Title: the property, else the first heading, else the largest text on page one. Authors as an array.

    ``docs``: doc_id, title_property, author_property, headings (array), first_page (array of text and size).
    """
    largest = F.array_max(F.transform("first_page", lambda l, i: F.struct(
        l["size"].alias("size"), (-i).alias("no"), l["text"].alias("text"))))["text"]
    title = F.coalesce(F.nullif(tx.strip("title_property"), F.lit("")), F.try_element_at("headings", F.lit(1)),
                       F.nullif(tx.strip(largest), F.lit("")))
    authors = F.filter(F.transform(F.split("author_property", r"[;,、；]|\\and\b"), tx.strip), lambda a: a != "")
    return docs.select("doc_id", title.alias("title"), F.coalesce(authors, F.array()).alias("authors"))


def deck_defaults(meta: DataFrame) -> DataFrame:
    """Deck headers from document metadata: closed language set, title fallback, first author presents."""
    lang = F.when(F.col("lang").isin("zh", "en"), F.col("lang")).otherwise("mixed")
    return meta.select("doc_id", lang.alias("language"), F.coalesce("title", F.lit("未命名报告")).alias("title"),
                       F.try_element_at("authors", F.lit(1)).alias("presenter"))


# Fields a reader would notice; anything else is pruned before the diff join.
DIFF_BLOCK_FIELDS = ("block_uid", "content", "channel", "pinned", "importance_milli")
DIFF_SLIDE_FIELDS = ("slide_uid", "title", "role", "is_backup", "dwell_seconds")


def diff_fields(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    return df.select(*[f for f in fields if f in df.columns])
