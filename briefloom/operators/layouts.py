"""Matching slides to page layouts by role and measured capacity.

``layouts``: template_id, layout_id, layout_no, name, roles. ``slots``: template_id, layout_id, slot_id, kind, x, y, w, h,
capacity_units, capacity_lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from briefloom import scale
from briefloom.operators import model as md

# Fallback roles, in order, and name hints.
FALLBACK = {
    "cover": ("section", "text_dense"), "agenda": ("text_dense", "summary"), "section": ("cover", "text_dense"),
    "text_dense": ("two_column", "summary", "agenda"), "text_figure": ("two_column", "big_figure", "text_dense"),
    "big_figure": ("text_figure", "text_dense"), "two_column": ("text_figure", "text_dense"),
    "three_column": ("two_column", "text_dense"), "table": ("big_figure", "text_figure", "text_dense"),
    "equation": ("text_dense", "big_figure"), "timeline": ("text_dense", "two_column"),
    "summary": ("text_dense", "agenda"), "acknowledgement": ("section", "cover"), "backup": ("text_dense",),
}
NAME_HINTS = (
    (("title slide", "cover", "封面", "标题幻灯片"), ("cover",)), (("section", "章节", "节标题"), ("section",)),
    (("agenda", "outline", "contents", "目录", "大纲"), ("agenda",)),
    (("comparison", "对比", "两栏", "two content"), ("two_column",)), (("three", "三栏"), ("three_column",)),
    (("picture", "image", "figure", "图片", "图"), ("big_figure",)), (("table", "表格"), ("table",)),
    (("equation", "formula", "公式"), ("equation",)), (("timeline", "时间线", "计划"), ("timeline",)),
    (("summary", "conclusion", "总结", "结论"), ("summary",)), (("thank", "acknowledg", "致谢", "感谢"), ("acknowledgement",)),
    (("backup", "reserve", "备用", "附录", "appendix"), ("backup",)), (("blank", "空白"), ()),
)
LOW_TITLE = 0.45
LARGE_BODY = 0.18
FEW_BLOCKS = 4


def layout_features(layouts: DataFrame, slots: DataFrame) -> DataFrame:
    """Per layout: slot counts, areas, capacities and the two penalties. Slots of a layout are a page's worth."""
    kind, area = F.col("kind"), F.col("w") * F.col("h")
    body, fig = kind == "body", kind.isin("figure", "table")
    units = F.coalesce("capacity_units", F.lit(0))
    first_title = F.min_by(units, F.when(kind == "title", F.col("slot_id")))
    f = slots.groupBy("template_id", "layout_id").agg(
        F.count_if(body).alias("bodies"), F.count_if(fig).alias("figures"), F.count_if(kind == "title").alias("titles"),
        F.count_if(kind == "subtitle").alias("subtitles"), F.count_if(kind == "figure").alias("figure_only"),
        F.coalesce(F.max(F.when(fig, area)), F.lit(0.0)).alias("fig_area"),
        F.coalesce(F.max(F.when(body, area)), F.lit(0.0)).alias("body_area"),
        F.coalesce(F.sum(F.when(body, area)), F.lit(0.0)).alias("text_area"),
        F.coalesce(F.sum(F.when(body, units)), F.lit(0)).alias("body_units"),
        F.coalesce(F.sum(F.when(body | (kind == "title"), units)), F.lit(0)).alias("text_units"),
        F.coalesce(F.max(F.when(body, F.coalesce("capacity_lines", F.lit(0)))), F.lit(0)).alias("lines"),
        F.coalesce(first_title, F.lit(0)).alias("title_units"),
        F.coalesce(F.min(F.when(kind == "title", F.col("y"))) > LOW_TITLE, F.lit(False)).alias("low_title"),
        F.count_if(F.col("capacity_units").isNull()).alias("unmeasured"))
    name = F.lower("name")
    return layouts.join(f, ["template_id", "layout_id"]).withColumn(
        "vertical", name.contains("vertical") | name.contains("竖"))


def text_capacity(layouts: DataFrame, slots: DataFrame) -> DataFrame:
    return layout_features(layouts, slots).select("template_id", "layout_id", F.col("text_units").alias("text_capacity"))


def supported_roles(layouts: DataFrame) -> DataFrame:
    return layouts.select("template_id", F.explode("roles").alias("role")).distinct()


def missing_roles(slides: DataFrame, layouts: DataFrame) -> DataFrame:
    """Roles a deck needs that its template does not offer."""
    needed = slides.select("deck_uid", "template_id", "role").distinct()
    return needed.join(supported_roles(layouts), ["template_id", "role"], "left_anti")


def layouts_for(layouts: DataFrame, slots: DataFrame, role: str) -> DataFrame:
    """Candidates for a role, ordered by capacity (rank 1 first)."""
    f = layout_features(layouts, slots).filter(F.array_contains("roles", role))
    order = Window.partitionBy("template_id").orderBy(F.desc("text_units"), F.asc("layout_no"))
    return f.select("template_id", "layout_id", "layout_no", "text_units").withColumn("rank", F.row_number().over(order))


def classify_layout(features: DataFrame) -> DataFrame:
    """Adds roles_found: from the layout's name, else from what it is made of."""
    name = F.lower(F.coalesce("name", F.lit("")))
    b, f, t, s = F.col("bodies"), F.col("figure_only"), F.col("titles") > 0, F.col("subtitles") > 0

    def roles(*names: str) -> Column:
        return F.array(*[F.lit(n) for n in names]).cast("array<string>")

    def more(base: Column) -> Column:
        big = F.when((b == 1) & (F.col("body_area") > LARGE_BODY), roles("text_figure", "table")).otherwise(roles())
        two = F.when(b >= 2, roles("two_column")).otherwise(roles())
        return F.array_distinct(F.concat(base, big, two))

    out = F
    for words, given in NAME_HINTS:
        hit = name.rlike("|".join(words))
        out = out.when(hit, more(roles(*given)) if given else roles())
    out = (out.when(t & s & (b == 0), roles("cover")).when(t & (b == 0) & (f == 0), roles("section", "acknowledgement"))
           .when(b >= 3, roles("three_column", "text_dense"))
           .when(b == 2, roles("two_column", "text_figure", "text_dense"))
           .when((f > 0) & (b > 0), roles("text_figure", "big_figure", "table"))
           .when((f > 0) & (b == 0), roles("big_figure", "table"))
           .when(b == 1, more(roles("text_dense", "agenda", "summary", "equation"))).otherwise(roles()))
    return features.withColumn("roles_found", out)


def ingest_report(features: DataFrame) -> DataFrame:
    """Layouts found and kept, roles covered and slots without a measure, per template."""
    c = classify_layout(features)
    return c.groupBy("template_id").agg(
        F.count(F.lit(1)).alias("layouts_found"), F.count_if(F.size("roles_found") > 0).alias("layouts_kept"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("roles_found")))), ",").alias("roles_covered"),
        F.sum("unmeasured").alias("unmeasured_slots"))


def slide_needs(slides: DataFrame, blocks: DataFrame) -> DataFrame:
    """Slides with how many visuals and texts they show, by partial aggregation."""
    shown = blocks.filter(F.col("channel") == "slide").groupBy("slide_uid").agg(
        F.count_if(md.is_visual()).alias("v"), F.count_if(~md.is_visual() & (F.col("type") != "note")).alias("t"))
    return (slides.join(shown, "slide_uid", "left")
            .withColumn("wants_visual", F.coalesce("v", F.lit(0)))
            .withColumn("wants_text", F.least(F.coalesce("t", F.lit(0)), F.lit(5))).drop("v", "t"))


def bind_layouts(slides: DataFrame, layouts: DataFrame, slots: DataFrame) -> DataFrame:
    """Choose a layout for every slide (with wants_visual and wants_text) and measure what it holds.

    The choice depends only on the slide's profile, so layouts are scored once per distinct profile and slides read
    the result back: the many slides of one template never meet its layouts pair by pair.
    """
    key = ["template_id", "role", "layout_hint", "wants_visual", "wants_text"]
    profiles = slides.select(*key).distinct()
    f = layout_features(layouts, slots)
    c = profiles.join(f, "template_id")
    v, t = F.col("wants_visual"), F.col("wants_text")
    pool_area = F.when(F.col("figures") > 0, F.col("fig_area")).otherwise(F.col("body_area"))
    ideal = F.when(t <= 4, 1).otherwise(F.least("bodies", F.lit(2)))
    columns = F.when(F.col("bodies") <= 1, 0).otherwise(F.col("bodies") - ideal)
    coexist = F.when((v > 0) & (t > 0) & (F.col("figures") + F.col("bodies") >= v + 1), 1).otherwise(0)
    alts = F.create_map(*[x for k, vs in FALLBACK.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in vs]))])
    at = F.filter(F.transform(F.coalesce(alts[F.col("role")], F.array().cast("array<string>")),
                              lambda a, i: F.when(F.array_contains("roles", a), i)), lambda i: i.isNotNull())
    c = c.withColumn("exact", F.array_contains("roles", F.col("role"))).withColumn("prio", F.array_min(at))
    score = F.struct(coexist.alias("s1"), (-(v - F.least("figures", v))).alias("s2"),
                     (-F.col("vertical").cast("int")).alias("s3"), (-F.col("low_title").cast("int")).alias("s4"),
                     F.when(v > 0, F.round(pool_area, 3)).otherwise(0.0).alias("s5"), (-F.abs(columns)).alias("s6"),
                     F.round("text_area", 3).alias("s7"), F.col("text_units").alias("s8"))
    me = F.struct("layout_id", "low_title", "bodies", "figures", "body_units", "title_units", "lines")
    no = -F.col("layout_no")
    best = c.groupBy(*key).agg(
        F.min_by(me, F.when(F.col("layout_id") == F.col("layout_hint"), F.col("layout_no"))).alias("hint"),
        F.max_by(me, F.when(F.col("exact"), F.struct(score, no))).alias("best_exact"),
        F.max_by(me, F.when(F.col("prio").isNotNull() & ~F.col("low_title"), F.struct(score, -F.col("prio"), no)))
        .alias("viable"),
        F.max_by(me, F.when(F.col("prio").isNotNull(), F.struct(-F.col("prio"), score, no))).alias("fallback"),
        F.max_by(me, F.struct("text_units", no)).alias("any"))
    poor = F.col("best_exact.low_title")
    chosen = (F.when(F.col("hint").isNotNull(), F.col("hint"))
              .when(F.col("best_exact").isNotNull() & ~(poor & F.col("viable").isNotNull()), F.col("best_exact"))
              .when(F.col("best_exact").isNotNull(), F.col("viable")).otherwise(F.coalesce("fallback", "any")))
    sub = F.col("hint").isNull() & (F.col("best_exact").isNull() | (poor & F.col("viable").isNotNull()))
    choice = best.select(*[F.col(k).alias(f"__{k}") for k in key], chosen.alias("c"), sub.alias("substituted"))
    on = [slides[k].eqNullSafe(choice[f"__{k}"]) for k in key]
    s = slides.join(choice, on, "left").drop(*[f"__{k}" for k in key])
    cap = F.when((F.col("wants_visual") > 0) & (F.col("c.figures") == 0) & (F.col("c.bodies") > 0),
                 F.floor(F.col("c.body_units") * 45 / 100)).otherwise(F.col("c.body_units"))
    return (s.withColumn("layout_id", F.col("c.layout_id")).withColumn("text_capacity", cap.cast("long"))
            .withColumn("title_capacity", F.col("c.title_units")).withColumn("body_slots", F.col("c.bodies"))
            .withColumn("figure_slots", F.col("c.figures")).withColumn("bullet_lines", F.col("c.lines")).drop("c"))


def capacity_caps(bound: DataFrame) -> DataFrame:
    return bound.select("slide_uid", "text_capacity", "bullet_lines")


def title_overflows(bound: DataFrame) -> DataFrame:
    """Slides whose title needs more units than its slot holds (needs title_units)."""
    return bound.filter((F.col("title_capacity") > 0) & (F.col("title_units") > F.col("title_capacity")))


def overflow_rate(bound: DataFrame, blocks: DataFrame) -> DataFrame:
    """Share of bound slides per deck whose page text exceeds the measured capacity."""
    used = blocks.filter((F.col("channel") == "slide") & ~md.is_visual()).groupBy("slide_uid").agg(
        F.sum("units").alias("used"))
    over = (F.col("text_capacity") > 0) & (F.coalesce("used", F.lit(0)) > F.col("text_capacity"))
    return (bound.filter("layout_id IS NOT NULL").join(used, "slide_uid", "left").groupBy("deck_uid")
            .agg(F.count(F.lit(1)).alias("bound"), F.count_if(over).alias("over"))
            .withColumn("rate", F.round(F.col("over") / F.col("bound"), 4)))


def place_visuals(needs: DataFrame, visuals: DataFrame, slots: DataFrame) -> DataFrame:
    """Visuals take figure slots largest first, then spare body slots, never the last one while text waits.

    ``needs``: slide_uid, template_id, layout_id, wants_text. ``visuals``: slide_uid, block_uid, visual_no (from 1).
    A layout's slots are one short array; each visual picks by its number, so nothing is paired up.
    """
    area = F.col("w") * F.col("h")
    arr = slots.groupBy("template_id", "layout_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("kind").isin("figure", "table"), F.struct(
            (-area).alias("a"), "slot_id")))), lambda x: x["slot_id"]).alias("figs"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "body", F.struct((-area).alias("a"), "slot_id")))),
                    lambda x: x["slot_id"]).alias("bods"))
    n = F.col("visual_no").cast("int")
    spare = F.size("bods") - F.when(F.col("wants_text") > 0, 1).otherwise(0)
    extra = n - F.size("figs")
    slot = F.when(extra <= 0, F.try_element_at("figs", n)).when(extra <= spare, F.try_element_at("bods", extra))
    return (visuals.join(needs.select("slide_uid", "template_id", "layout_id", "wants_text"), "slide_uid")
            .join(arr, ["template_id", "layout_id"]).select("slide_uid", "block_uid", "visual_no", slot.alias("slot_id")))


def distribute_columns(blocks: DataFrame, needs: DataFrame, max_columns: int = 3) -> DataFrame:
    """Column of each text block: all in the first while there are few, else the next column once one holds its share.

    ``blocks``: slide_uid, block_no, weight. ``needs``: slide_uid, caps (capacity of each column, largest first).
    A block's column follows from the weight before it, so running sums replace the walk.
    """
    chunk = {"__c1": F.floor(F.col("block_no") / 512)}
    b = scale.running(blocks, ["slide_uid"], chunk, ["block_no"], {"before": F.col("weight")})
    b = scale.with_totals(b, ["slide_uid"], {"total": F.sum("weight"), "n": F.count(F.lit(1))})
    b = b.join(needs, "slide_uid").withColumn("caps", F.transform("caps", lambda c: F.greatest(c, F.lit(1))))
    b = b.withColumn("column", F.lit(0)).withColumn("__base", F.lit(0).cast("long"))
    whole = F.aggregate("caps", F.lit(0).cast("long"), lambda a, c: a + c)
    for j in range(max_columns - 1):
        # A block moves on once the column before it has taken its share of the weight.
        full = ((F.col("before") - F.col("__base")) * whole >= F.try_element_at("caps", F.lit(j + 1)) * F.col("total"))
        moves = (F.col("column") == j) & (F.size("caps") > j + 1) & (F.col("n") > FEW_BLOCKS) & full & (
            F.col("before") > F.col("__base"))
        b = b.withColumn("column", F.when(moves, j + 1).otherwise(F.col("column")))
        b = scale.with_totals(b.drop("__base"), ["slide_uid"], {
            "__base": F.min(F.when(F.col("column") == j + 1, F.col("before")))})
    return b.drop("__base", "total", "n", "before", "caps")
