"""From segments to sections, pages and blocks.

A document arrives as one row holding its segments as an array, and every order-dependent rule (grouping, packing,
merging) is a running fold inside that row. Nothing is shuffled until pages and blocks leave as rows of their own.

Segments: ARRAY<STRUCT<seg_no, kind, text, level, asset_id>>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from briefloom import scale
from briefloom.functions import claims as cl
from briefloom.functions import text as tx
from briefloom.operators import budget as bg

# Order of recognised sections in a grant defence, and the standing texts of navigation pages.
SECTION_ORDER = ("motivation", "objectives", "innovation", "methods", "prior_work", "results", "feasibility",
                 "schedule", "risks", "budget", "conclusion")
DIVIDER_SCENARIOS = ("grant_defense", "thesis_defense", "conference_oral")
ORDINALS = ("一", "二", "三", "四", "五", "六", "七", "八", "九", "十", "十一", "十二", "十三", "十四", "十五", "十六",
            "十七", "十八")
PLACEHOLDER = (rf"(?i)^[{tx.SPACE}]*\[(?:figure|table|表格|图)(?![\p{{L}}\p{{N}}_])"
               rf"|^[{tx.SPACE}]*\[[a-z]+-\d+\][{tx.SPACE}]*$")
COUNTED = ("paragraph", "list_item")


def _is_cut(level: Column, s: Column) -> Column:
    return (s["kind"] == "heading") & (s["level"] <= level)


def heading_groups(docs: DataFrame) -> DataFrame:
    """Adds cut_level and groups: for every segment its group number and the title of its group.

    Groups start at top headings; a document with at most one of those is regrouped at level two when that
    yields more groups.
    """
    def groups_at(n: int) -> tuple[Column, Column]:
        headed = F.size(F.filter("segs", lambda s: _is_cut(F.lit(n), s)))
        first = F.try_element_at("segs", F.lit(1))
        loose = F.when((F.size("segs") > 0) & ~_is_cut(F.lit(n), first), 1).otherwise(0)
        return headed, headed + loose

    h1, g1 = groups_at(1)
    _, g2 = groups_at(2)
    docs = docs.withColumn("cut_level", F.when((h1 <= 1) & (g2 > g1), 2).otherwise(1))
    start = F.struct(F.lit(0).alias("no"), F.lit("").alias("title"), F.lit(False).alias("head"),
                     F.lit(False).alias("opens"))

    def step(st: Column, s: Column) -> Column:
        cut = _is_cut(F.col("cut_level"), s)
        fresh = cut | (st["no"] == 0)
        return F.struct((st["no"] + fresh.cast("int")).alias("no"),
                        F.when(cut, s["text"]).when(fresh, "").otherwise(st["title"]).alias("title"),
                        F.when(fresh, cut).otherwise(st["head"]).alias("head"), cut.alias("opens"))

    shape = "struct<no:int,title:string,head:boolean,opens:boolean>"
    return docs.withColumn("groups", scale.scan(F.col("segs"), start, step, lambda st: st, shape, shape))


def front_matter(docs: DataFrame) -> DataFrame:
    """Adds has_front (the first group is a title block) and the affiliation found in it."""
    paired = F.zip_with("segs", "groups", lambda s, g: F.struct(s.alias("s"), g.alias("g")))
    first = F.filter(paired, lambda p: (p["g"]["no"] == 1) & ~p["g"]["opens"])
    group = F.try_element_at("groups", F.lit(1))
    titled = F.coalesce(tx.strip(group["title"]) == tx.strip(F.col("title")), F.lit(False))
    prose = F.exists(first, lambda p: (p["s"]["kind"] == "paragraph") & (F.length(p["s"]["text"]) > 80))
    docs = docs.withColumn("has_front", (F.size("segs") > 0) & (~group["head"] | titled) & ~prose)
    word = f"(?i){cl.INSTITUTION}"
    line = F.try_element_at(F.filter(first, lambda p: p["s"]["text"].rlike(word)), F.lit(1))["s"]["text"]
    return docs.withColumn("affiliation", F.when(F.col("has_front"), cl.affiliation_of(tx.strip(line))))


def section_paths(docs: DataFrame) -> DataFrame:
    """Adds paths: the enclosing heading titles of every segment, outermost first.

    A heading of level L keeps the first L-1 titles of the stack, whatever levels they had.
    """
    state = "struct<stack:array<string>,here:array<string>>"
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<string>").alias("here"))

    def step(st: Column, s: Column) -> Column:
        cut = F.slice(st["stack"], F.lit(1), F.greatest(s["level"] - 1, F.lit(0)))
        head = s["kind"] == "heading"
        return F.struct(F.when(head, F.concat(cut, F.array(s["text"]))).otherwise(st["stack"]).alias("stack"),
                        F.when(head, cut).otherwise(st["stack"]).alias("here"))

    return docs.withColumn("paths", scale.scan(F.col("segs"), start, step, lambda st: st["here"], state,
                                               "array<string>"))


def reference_zone(segments: DataFrame) -> DataFrame:
    """Flags rows after a references heading until the next heading (row form, any document length)."""
    is_ref = F.col("text").rlike(rf"(?i)^[{tx.SPACE}]*(references?|bibliography|参考文献)[{tx.SPACE}]*$")
    flag = F.when(F.col("kind") == "heading", is_ref)
    out = scale.latest_before(segments, ["doc_id"], scale.position_chunk("seg_no"), ["seg_no"], {"zone": flag})
    return out.withColumn("in_references", F.coalesce("zone", F.lit(False)) & (F.col("kind") != "heading")).drop("zone")


def float_runs(segments: DataFrame) -> DataFrame:
    """Numbers runs of adjacent segments of one asset (row form)."""
    chunk = scale.position_chunk("seg_no")
    seen = scale.previous(segments, ["doc_id"], chunk, ["seg_no"], {"__before": F.col("asset_id")})
    fresh = F.col("asset_id").isNotNull() & ~F.coalesce(F.col("__before") == F.col("asset_id"), F.lit(False))
    seen = seen.withColumn("__fresh", fresh.cast("int"))
    out = scale.running(seen, ["doc_id"], chunk, ["seg_no"], {"__sum": F.col("__fresh")})
    return out.withColumn("run_no", F.when(F.col("asset_id").isNotNull(), (F.col("__sum") + F.col("__fresh"))
                                           .cast("long"))).drop("__before", "__fresh", "__sum")


# --------------------------------------------------------------------- blocks


def segment_block(s: Column, rubric: Column, unit_limit: Column | int | None, claims=cl.CLAIM_WORDS,
                  elaborations=cl.ELABORATION_WORDS, has_asset: Column | None = None) -> Column:
    """The block a segment yields as a STRUCT; null for kinds that never become content."""
    kind, text = s["kind"], s["text"]
    base = cl.score_segment(kind, text, rubric, claims, elaborations)
    owned = s["asset_id"].isNotNull() if has_asset is None else has_asset
    table = (kind == "table") | s["asset_id"].startswith("tbl")
    visible = F.when((kind == "caption") & ~text.rlike(PLACEHOLDER), text).otherwise(F.lit(""))
    cut = tx.split_claim(text, unit_limit)

    def block(type_, content, imp, derivation, channel, note, level) -> Column:
        return F.struct(type_.alias("type"), content.alias("content"), imp.cast("int").alias("importance_milli"),
                        derivation.alias("derivation"), channel.alias("channel"),
                        note.cast("string").alias("speaker_note"), level.cast("int").alias("level"))

    page, verbatim, none = F.lit("slide"), F.lit("verbatim"), F.lit(None)
    bullet = block(F.lit("bullet"), cut["headline"], base,
                   F.when(cut["headline"] == text, "verbatim").otherwise("compressed"),
                   F.when(base >= 350, "slide").otherwise("script"), cut["note"], F.least(s["level"], F.lit(2)))
    return (F.when(owned, block(F.when(table, "table").otherwise("figure"), visible, cl.clamp(base + 150), verbatim,
                                page, none, F.lit(0)))
            .when(kind == "equation", block(kind, text, cl.clamp(base + 100), verbatim, page, none, F.lit(0)))
            .when(kind.isin("code", "quote"), block(kind, text, base, verbatim, page, none, F.lit(0)))
            .when(kind.isin("paragraph", "list_item", "caption"), bullet))


# ---------------------------------------------------------------------- pages


def pack_pages(docs: DataFrame, density: str = "balanced", body_kinds=None) -> DataFrame:
    """Adds pages: for every segment its page in the document, and the segment that titles it.

    A page ends at a subheading, at a float, or after the segment that fills it. Page numbers run through the
    document; a page never spans two groups. ``title_at`` is the position of the titling subheading, 0 for the
    group's own title.
    """
    cap, units_cap = bg.PROFILES[density]["max_bullets"], bg.PROFILES[density]["slide_cap"]
    shape = ("struct<page:int,open:string,asset:string,cnt:int,units:int,title_at:int,on:boolean,grp:int,gt:string>")
    none = F.lit(None).cast("string")
    start = F.struct(F.lit(0).alias("page"), F.lit("none").alias("open"), none.alias("asset"), F.lit(0).alias("cnt"),
                     F.lit(0).alias("units"), F.lit(0).alias("title_at"), F.lit(False).alias("on"), F.lit(0).alias("grp"),
                     F.lit("").alias("gt"))
    items = F.zip_with("segs", "groups", lambda s, g: F.struct(
        s["kind"].alias("kind"), s["asset_id"].alias("asset_id"), g["no"].alias("grp"), g["opens"].alias("opens"),
        g["title"].alias("gt"),
        F.when(s["kind"].isin(*COUNTED), tx.count_units(s["text"])).otherwise(0).alias("u"),
        s["kind"].isin(*COUNTED).cast("int").alias("c")))
    items = F.transform(items, lambda x, i: F.struct(x.alias("x"), (i + 1).alias("at")))

    def step(st: Column, it: Column) -> Column:
        x = it["x"]
        moved = x["grp"] != st["grp"]
        open_ = F.when(moved, "none").otherwise(st["open"])
        skip = x["kind"] == "reference"
        head = x["kind"] == "heading"
        fl = ~head & ~skip & ((x["kind"] == "table") | x["asset_id"].isNotNull())
        same = fl & (open_ == "float") & F.coalesce(x["asset_id"] == st["asset"], F.lit(False))
        joins = ~head & ~fl & ~skip & (open_ == "text")
        fresh = ~head & ~skip & ~same & ~joins
        cnt = F.when(fl | head, 0).otherwise(F.when(joins, st["cnt"]).otherwise(0) + x["c"])
        units = F.when(fl | head, 0).otherwise(F.when(joins, st["units"]).otherwise(0) + x["u"])
        full = ~fl & ~head & ~skip & ((cnt >= cap) | (units >= units_cap))
        title = F.when(x["opens"], 0).when(head, it["at"]).when(moved, 0).otherwise(st["title_at"])
        return F.struct(
            (st["page"] + fresh.cast("int")).alias("page"),
            F.when(skip, open_).when(head, F.when(open_ == "float", "float").otherwise("none"))
            .when(fl, "float").when(full, "none").otherwise("text").alias("open"),
            F.when(fl, x["asset_id"]).otherwise(st["asset"]).alias("asset"),
            F.when(skip, st["cnt"]).otherwise(cnt).alias("cnt"), F.when(skip, st["units"]).otherwise(units).alias("units"),
            title.alias("title_at"), (~head & ~skip).alias("on"), x["grp"].alias("grp"), x["gt"].alias("gt"))

    out = "struct<page:int,title_at:int,on:boolean,grp:int,gt:string>"
    return docs.withColumn("pages", scale.scan(
        items, start, step, lambda st: F.struct(st["page"], st["title_at"], st["on"], st["grp"], st["gt"]), shape, out))


def coalesce_pages(docs: DataFrame, density: str = "balanced") -> DataFrame:
    """Adds final: the page each packed page ends up on after under-filled neighbours are merged.

    Needs ``page_list``: ARRAY<STRUCT<page, grp, title, visual, n, units>> in order. Two pages join when they share
    group and title, neither shows a visual, and their union keeps both caps.
    """
    cap, units_cap = bg.PROFILES[density]["max_bullets"], bg.PROFILES[density]["slide_cap"]
    shape = "struct<no:int,grp:int,title:string,visual:boolean,n:int,units:int,page:int>"
    start = F.struct(F.lit(0).alias("no"), F.lit(-1).alias("grp"), F.lit("").alias("title"),
                     F.lit(True).alias("visual"), F.lit(0).alias("n"), F.lit(0).alias("units"), F.lit(0).alias("page"))

    def step(st: Column, p: Column) -> Column:
        fits = ((p["grp"] == st["grp"]) & (p["title"] == st["title"]) & ~p["visual"] & ~st["visual"]
                & (p["n"] + st["n"] <= cap) & (p["units"] + st["units"] <= units_cap))
        return F.struct((st["no"] + (~fits).cast("int")).alias("no"), p["grp"].alias("grp"), p["title"].alias("title"),
                        p["visual"].alias("visual"), (F.when(fits, st["n"]).otherwise(0) + p["n"]).alias("n"),
                        (F.when(fits, st["units"]).otherwise(0) + p["units"]).alias("units"), p["page"].alias("page"))

    return docs.withColumn("final", scale.scan(
        F.col("page_list"), start, step, lambda st: F.struct(st["page"], st["no"]), shape, "struct<page:int,no:int>"))


def page_totals(docs: DataFrame) -> DataFrame:
    """Adds page_list from segs, pages and blocks (one block or null per segment), in one running pass."""
    items = F.transform("segs", lambda s, i: F.struct(
        F.element_at("pages", i + 1).alias("p"), F.element_at("blocks", i + 1).alias("b"), s.alias("s")))
    shape = "struct<page:int,grp:int,gt:string,title_at:int,caption:string,visual:boolean,n:int,units:int,any:boolean>"
    start = F.struct(F.lit(0).alias("page"), F.lit(0).alias("grp"), F.lit("").alias("gt"), F.lit(0).alias("title_at"),
                     F.lit(None).cast("string").alias("caption"), F.lit(False).alias("visual"), F.lit(0).alias("n"),
                     F.lit(0).alias("units"), F.lit(False).alias("any"))

    def step(st: Column, it: Column) -> Column:
        p, b, s = it["p"], it["b"], it["s"]
        fresh = p["page"] != st["page"]
        has = p["on"] & b.isNotNull()
        vis = F.coalesce(has & b["type"].isin("figure", "table"), F.lit(False))
        text = F.coalesce(has & ~b["type"].isin("figure", "table"), F.lit(False))
        keep = ~fresh
        # The title in force while the page is open; a subheading met by an open float renames it.
        late = p["on"] | st["visual"]
        cap = F.when(p["on"] & (s["kind"] == "caption") & s["asset_id"].isNotNull(), s["text"])
        return F.struct(
            p["page"].alias("page"), F.when(fresh, p["grp"]).otherwise(st["grp"]).alias("grp"),
            F.when(fresh, p["gt"]).otherwise(st["gt"]).alias("gt"),
            F.when(fresh | (late & (p["grp"] == st["grp"])), p["title_at"]).otherwise(st["title_at"]).alias("title_at"),
            F.when(fresh, cap).otherwise(F.coalesce(st["caption"], cap)).alias("caption"),
            (F.when(keep, st["visual"]).otherwise(F.lit(False)) | vis).alias("visual"),
            (F.when(keep, st["n"]).otherwise(0) + text.cast("int")).alias("n"),
            (F.when(keep, st["units"]).otherwise(0) + F.when(text, tx.count_units(b["content"])).otherwise(0))
            .alias("units"),
            (F.when(keep, st["any"]).otherwise(F.lit(False)) | F.coalesce(has, F.lit(False))).alias("any"))

    docs = docs.withColumn("__run", scale.scan(items, start, step, lambda st: st, shape, shape))
    last = F.filter("__run", lambda r, i: F.coalesce(
        F.try_element_at("__run", i + 2)["page"] != r["page"], F.lit(True)) & (r["page"] > 0) & r["any"])

    def titled(r: Column) -> Column:
        base = F.when(r["title_at"] > 0, F.try_element_at("segs", r["title_at"])["text"]).otherwise(
            F.when(r["gt"] != "", r["gt"]).otherwise(F.coalesce("title", F.lit("概述"))))
        title = F.when(r["caption"].isNotNull() & r["visual"], tx.caption_title(r["caption"], base)).otherwise(base)
        return F.struct(r["page"].alias("page"), r["grp"].alias("grp"), tx.tidy_title(title).alias("title"),
                        r["visual"].alias("visual"), r["n"].alias("n"), r["units"].alias("units"))

    return docs.withColumn("page_list", F.transform(last, titled)).drop("__run")


def infer_role(has_table: Column, has_figure: Column, has_equation: Column, has_text: Column) -> Column:
    return (F.when(has_table, "table").when(has_figure & has_text, "text_figure").when(has_figure, "big_figure")
            .when(has_equation, "equation").otherwise("text_dense"))


def merge_asset_blocks(blocks: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Blocks of one asset on one page become one: first content, all spans once, highest importance.

    Blocks without an asset pass by untouched."""
    named = blocks.filter(F.col("asset_id").isNotNull())
    filled = F.when(F.col("content") != "", F.col("content"))
    merged = named.groupBy(*keys, "asset_id").agg(
        F.min("seg_no").alias("seg_no"), F.min_by("type", "seg_no").alias("type"),
        F.coalesce(F.min_by(filled, F.when(filled.isNotNull(), F.col("seg_no"))), F.lit("")).alias("content"),
        F.max("importance_milli").alias("importance_milli"),
        F.array_sort(F.collect_set(F.struct("seg_no"))).alias("spans"))
    rest = blocks.filter(F.col("asset_id").isNull()).select(
        *keys, "asset_id", "seg_no", "type", "content", "importance_milli",
        F.array(F.struct("seg_no")).alias("spans"))
    return merged.unionByName(rest)


# ------------------------------------------------------------------- sections


def order_sections(sections: DataFrame, scenario: str = "grant_defense") -> DataFrame:
    """Adds talk_no. Sections of a document came out of one row, so the window holds one document's headings."""
    rank = F.lit(0)
    if scenario == "grant_defense":
        ranks = F.create_map(*[F.lit(x) for i, k in enumerate(SECTION_ORDER) for x in (k, i)])
        rank = F.coalesce(ranks[F.col("rubric_key")], F.lit(len(SECTION_ORDER) // 2))
    w = Window.partitionBy("doc_id").orderBy(rank, "section_no")
    return sections.withColumn("talk_no", F.row_number().over(w).cast("long"))


def divider_numbers(sections: DataFrame, scenario: str = "grant_defense") -> DataFrame:
    """Adds divider_no and divider_title for the sections worth announcing.

    Needs live_pages (pages that are not backup) and pages per section."""
    w = Window.partitionBy("doc_id")
    presented = ~((F.col("pages") > 0) & (F.col("live_pages") == 0))
    many = F.count_if(presented).over(w) >= 4
    worth = many & presented & (F.col("live_pages") >= 2) & F.lit(scenario in DIVIDER_SCENARIOS)
    s = sections.withColumn("__worth", worth)
    n = F.count_if("__worth").over(w.orderBy("talk_no").rowsBetween(Window.unboundedPreceding, 0))
    label = F.when(n < len(ORDINALS) + 1, F.concat(F.try_element_at(
        F.array(*[F.lit(o) for o in ORDINALS]), n.cast("int")), F.lit("、"), F.col("title"))).otherwise(F.col("title"))
    return (s.withColumn("divider_no", F.when(F.col("__worth"), n))
            .withColumn("divider_title", F.when(F.col("__worth"), label)).drop("__worth"))


def navigation_pages(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """Cover, agenda, dividers and closing page of each document with their place among the sections.

    ``docs``: doc_id, title, authors, affiliation. ``sections``: with talk_no, divider_title and item counts.
    """
    presented = sections.filter(~((F.col("pages") > 0) & (F.col("live_pages") == 0)))
    items = presented.groupBy("doc_id").agg(F.count(F.lit(1)).alias("items"))
    byline = F.when(F.size("authors") > 0, F.array_join(F.slice("authors", 1, 3), "、"))
    d = docs.join(sections.select("doc_id").distinct(), "doc_id", "left_semi").join(items, "doc_id", "left")
    subtitle = F.concat_ws("\n", byline, "affiliation")

    def page(role: str, section: Column, title: Column, sub: Column) -> DataFrame:
        return d.select("doc_id", F.lit(role).alias("role"), section.cast("long").alias("talk_no"),
                        title.alias("title"), F.nullif(sub, F.lit("")).alias("subtitle"))

    nothing = F.lit(None).cast("string")
    cover = page("cover", F.lit(0), F.coalesce("title", F.lit("未命名报告")), subtitle)
    agenda = page("agenda", F.lit(0), F.lit("汇报内容"), nothing).join(items.filter("items >= 3"), "doc_id", "left_semi")
    closing = page("acknowledgement", F.lit(None), F.lit("谢谢"), F.lit("请各位专家批评指正"))
    dividers = sections.filter("divider_no IS NOT NULL").select(
        "doc_id", F.lit("section").alias("role"), "talk_no", F.col("divider_title").alias("title"),
        nothing.alias("subtitle"))
    return cover.unionByName(agenda).unionByName(dividers).unionByName(closing)


def agenda_items(sections: DataFrame) -> DataFrame:
    """Agenda bullets: the presented sections in talk order, in documents with at least three.

    An item that names a heading cites it and is verbatim; any other is authored. All are pinned."""
    presented = sections.filter(~((F.col("pages") > 0) & (F.col("live_pages") == 0)))
    w = Window.partitionBy("doc_id")
    return (presented.withColumn("__n", F.count(F.lit(1)).over(w)).filter("__n >= 3")
            .select("doc_id", F.row_number().over(w.orderBy("talk_no")).cast("long").alias("block_no"),
                    F.col("title").alias("content"),
                    F.when(F.col("heading_seg").isNotNull(), "verbatim").otherwise("authored").alias("derivation"),
                    "heading_seg", F.lit(True).alias("pinned"), F.lit(500).alias("importance_milli")))


def build_assets(extracted: DataFrame) -> DataFrame:
    """Extracted assets as deck assets, marked as the author's own."""
    return extracted.withColumn("origin", F.lit("extracted"))
