"""Deck documents, manuscripts and edit logs as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = "struct<doc_id:string,start:int,end:int,locator:string,quote:string>"
BLOCK = (f"struct<uid:string,type:string,content:string,level:int,asset_ref:string,bound_to:string,derivation:string,"
         f"spans:array<{SPAN}>,needs_confirmation:boolean,importance:double,channel:string,word_budget:int,"
         f"speaker_note:string,channel_pinned:boolean,pinned:boolean,tags:array<string>>")
SLIDE = (f"struct<uid:string,role:string,title:string,subtitle:string,blocks:array<{BLOCK}>,dwell_seconds:double,"
         f"dwell_locked:boolean,layout_hint:string,is_backup:boolean,notes:string>")
SECTION = f"struct<uid:string,title:string,slides:array<{SLIDE}>,weight:double,rubric_key:string,intent:string>"
ASSET = (f"struct<uid:string,kind:string,origin:string,path:string,latex:string,data:struct<columns:array<string>,"
         f"rows:array<array<string>>>,caption:string,source_label:string,spans:array<{SPAN}>,intrinsic_aspect:double>")
SOURCE = "struct<doc_id:string,title:string,path:string,sha256:string,char_count:int>"
META = "struct<title:string,presenter:string,affiliation:string,venue:string,language:string,scenario:string>"
DELIVERY = ("struct<total_seconds:int,words_per_minute:int,density:string,target_dwell_seconds:double,reserve_ratio:double>")
DECK = (f"schema_version string, uid string, meta {META}, delivery {DELIVERY}, sections array<{SECTION}>, "
        f"assets array<{ASSET}>, sources array<{SOURCE}>, rubric_profile string")
OP = ("struct<op:string,target:string,value:string,channel:string,pinned:boolean,seconds:double,total_seconds:int,"
      "density:string,max_units:int,instruction:string,others:array<string>,to_slide:string,index:int,order:array<string>,"
      "after_block:string,role:string,is_backup:boolean,asset_ref:string,hard:boolean,rationale:string>")
LOG = (f"deck_uid string, patches array<struct<patch_id:string,created_at:timestamp,utterance:string,"
       f"selection:array<string>,operations:array<{OP}>,confidence:double>>")
SUPPORTED = ("docx", "pdf", "tex", "latex")


def read_decks(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Deck files (one document per file) as flat tables with ordinals. The schema is fixed, so nothing is inferred."""
    raw = spark.read.schema(DECK).option("multiLine", True).json(path)
    decks = raw.select(F.col("uid").alias("deck_uid"), "meta.*", "delivery.*", "rubric_profile")
    sec = raw.select(F.col("uid").alias("deck_uid"), F.posexplode("sections").alias("section_no", "s"))
    sl = sec.select("deck_uid", F.col("s.uid").alias("section_uid"), "section_no", F.posexplode("s.slides").alias("slide_no", "p"))
    bl = sl.select("deck_uid", F.col("p.uid").alias("slide_uid"), F.posexplode("p.blocks").alias("block_no", "b"))
    return {
        "decks": decks,
        "sections": sec.select("deck_uid", F.col("s.uid").alias("section_uid"), "section_no", "s.title", "s.weight", "s.rubric_key", "s.intent"),
        "slides": sl.select("deck_uid", "section_uid", F.col("p.uid").alias("slide_uid"), "section_no", "slide_no",
                            *[f"p.{n}" for n in ("role", "title", "subtitle", "dwell_seconds", "dwell_locked", "layout_hint", "is_backup", "notes")]),
        "blocks": bl.select("deck_uid", "slide_uid", F.col("b.uid").alias("block_uid"), "block_no",
                            *[f"b.{n}" for n in ("type", "content", "level", "asset_ref", "bound_to", "derivation", "spans",
                                                 "needs_confirmation", "importance", "channel", "word_budget", "speaker_note",
                                                 "channel_pinned", "pinned", "tags")]),
        "assets": raw.select(F.col("uid").alias("deck_uid"), F.explode("assets").alias("a")).select("deck_uid", F.col("a.uid").alias("asset_uid"), *[
            f"a.{n}" for n in ("kind", "origin", "path", "latex", "data", "caption", "source_label", "spans", "intrinsic_aspect")]),
        "sources": raw.select(F.col("uid").alias("deck_uid"), F.explode("sources").alias("d")).select("deck_uid", "d.*"),
    }


def _nest(children: DataFrame, keys: list[str], order: str, fields: list, name: str) -> DataFrame:
    row = F.struct(F.col(order).alias("no"), F.struct(*fields).alias("v"))
    return children.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["v"]).alias(name))


def slide_records(t: dict[str, DataFrame]) -> DataFrame:
    """One nested record per slide. A deck is a set of slide records, so no deck is gathered in one row."""
    b = t["blocks"]
    fields = [F.col("block_uid").alias("uid")] + [F.col(c) for c in b.columns if c not in ("deck_uid", "slide_uid", "block_uid", "block_no")]
    nested = _nest(b, ["deck_uid", "slide_uid"], "block_no", fields, "blocks")
    return t["slides"].join(nested, ["deck_uid", "slide_uid"], "left")


def write_decks(t: dict[str, DataFrame], path: str) -> None:
    """Tables as columnar files, slides as nested records partitioned for reading by deck."""
    for name, df in t.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    slide_records(t).write.mode("overwrite").json(f"{path}/slide_records")


def read_manuscripts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(manuscript texts, refused files with the reason naming what is supported). One file is one row."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    known = suffix.isin(*SUPPORTED)
    reason = F.concat(F.lit("unsupported suffix ."), suffix, F.lit("; supported: " + ", ".join(SUPPORTED)))
    return raw.filter(known).withColumn("format", suffix), raw.filter(~known).select("path", reason.alias("reason"))


def read_edit_log(spark: SparkSession, path: str) -> DataFrame:
    """Edit logs as op rows; a patch's place in its log is its order."""
    raw = spark.read.schema(LOG).option("multiLine", True).json(path)
    p = raw.select("deck_uid", F.posexplode("patches").alias("seq", "p"))
    return p.select("deck_uid", "seq", "p.patch_id", "p.created_at", "p.utterance", "p.selection", "p.confidence",
                    F.posexplode("p.operations").alias("op_no", "o")).select(
        "deck_uid", "seq", "op_no", "patch_id", "created_at", "utterance", "selection", "confidence", "o.*")


def write_edit_log(ops: DataFrame, path: str) -> None:
    """One record per patch: the log is append-only, so its unit is the patch, not the deck."""
    keys = ["deck_uid", "seq", "patch_id", "created_at", "utterance", "selection", "confidence"]
    args = [F.col(c) for c in ops.columns if c not in (*keys, "op_no")]
    _nest(ops, keys, "op_no", args, "operations").write.mode("overwrite").json(path)
