"""From requests in words to proposed edits.

Facts about each request (what is selected, which page it means, what that page holds) are gathered by equi-joins. The
rules are then column expressions over those facts, all evaluated at once, and the winner is a plain aggregation.
Requests and pages meet on exact keys only: a title on its own substring, an item on its number.

``requests``: utt_id, deck_uid, text, selection ARRAY<STRING>.
``slides``: deck_uid, slide_uid (string), page_no, title, dwell_seconds.
``blocks``: deck_uid, slide_uid, block_uid (string), block_no, content, channel, type, pinned, importance_milli,
asset_ref, word_budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom import scale
from briefloom.functions import cues as q
from briefloom.functions import text as tx
from briefloom.operators import model as md
from briefloom.session import cut_lineage

RULES = ("replace_text", "retime", "declutter", "shorten", "set_title", "split_slide", "merge", "delete", "pin", "emphasise",
         "backup", "figure_layout", "density")
SURE = 95


def selected_blocks(requests: DataFrame, slides: DataFrame, blocks: DataFrame) -> DataFrame:
    """(utt_id, pick_no, block): selected uids as blocks; a selected slide stands for all its blocks."""
    picks = requests.select("utt_id", "deck_uid", F.posexplode("selection").alias("pick_no", "uid"))
    b = blocks.select("deck_uid", "slide_uid", "block_uid", "block_no", "pinned", md.is_visual().alias("is_visual"))
    direct = picks.join(b.withColumnRenamed("block_uid", "uid"), ["deck_uid", "uid"]).withColumnRenamed("uid", "block_uid")
    whole = picks.withColumnRenamed("uid", "slide_uid").join(b, ["deck_uid", "slide_uid"])
    return direct.unionByName(whole).select("utt_id", "pick_no", "slide_uid", "block_uid", "block_no", "pinned", "is_visual")


def _selected_slide(requests: DataFrame, slides: DataFrame, blocks: DataFrame) -> DataFrame:
    picks = requests.select("utt_id", "deck_uid", F.posexplode("selection").alias("pick_no", "uid"))
    own = slides.select("deck_uid", F.col("slide_uid").alias("uid"), "slide_uid").unionByName(
        blocks.select("deck_uid", F.col("block_uid").alias("uid"), "slide_uid"))
    return picks.join(own, ["deck_uid", "uid"]).groupBy("utt_id").agg(F.min_by("slide_uid", "pick_no").alias("slide_uid"))


def title_mentions(requests: DataFrame, slides: DataFrame) -> DataFrame:
    """The page whose title a request mentions: the longest; two of one length are ambiguous (slide_uid null)."""
    titles = slides.filter(F.coalesce("title", F.lit("")) != "").groupBy("deck_uid", "title").agg(
        F.min_by("slide_uid", "page_no").alias("slide_uid"), F.count(F.lit(1)).alias("n"))
    hits = scale.contains_join(requests.select("utt_id", "deck_uid", "text"), "text", titles, "title", ["deck_uid"])
    per = hits.groupBy("utt_id", F.length("title").alias("len")).agg(F.sum("n").alias("n"), F.min("slide_uid").alias("slide_uid"))
    best = per.groupBy("utt_id").agg(F.max_by(F.struct("n", "slide_uid"), "len").alias("b"))
    return best.select("utt_id", F.when(F.col("b.n") == 1, F.col("b.slide_uid")).alias("slide_uid"),
                       (F.col("b.n") > 1).alias("ambiguous"))


def partial_mentions(requests: DataFrame, slides: DataFrame) -> DataFrame:
    """The first page whose title holds a run of two or more ideographs of the request."""
    phrase = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([\\u4e00-\\u9fff]{2,})"), F.lit(1))))
    phrases = requests.select("utt_id", "deck_uid", phrase.alias("phrase"))
    distinct = phrases.select("deck_uid", "phrase").distinct()
    titles = slides.filter(F.coalesce("title", F.lit("")) != "").groupBy("deck_uid", "title").agg(
        F.min(F.struct("page_no", "slide_uid")).alias("first"))
    hits = scale.contains_join(titles, "title", distinct, "phrase", ["deck_uid"])
    per = hits.groupBy("deck_uid", "phrase").agg(F.min("first").alias("first"))
    return phrases.join(per, ["deck_uid", "phrase"]).groupBy("utt_id").agg(F.min("first").alias("first")).select(
        "utt_id", F.col("first.slide_uid").alias("slide_uid"))


def resolve_slide(requests: DataFrame, slides: DataFrame, blocks: DataFrame) -> DataFrame:
    """Adds slide_uid, slide_pct and slide_why: selection, page number, title, part of a title, in that order.

    Only requests that the cheaper cues leave open enter the title joins.
    """
    r = requests.join(_selected_slide(requests, slides, blocks).withColumnRenamed("slide_uid", "__sel"), "utt_id", "left")
    r = r.withColumn("page", q.ordinal("text", "页"))
    by_no = slides.select("deck_uid", F.col("page_no").cast("int").alias("page"), F.col("slide_uid").alias("__no"))
    r = r.join(by_no, ["deck_uid", "page"], "left")
    open_ = r.filter("__sel IS NULL AND page IS NULL").select("utt_id", "deck_uid", "text")
    named = title_mentions(open_, slides).select("utt_id", F.col("slide_uid").alias("__title"), "ambiguous")
    part = partial_mentions(open_, slides).select("utt_id", F.col("slide_uid").alias("__part"))
    r = r.join(named, "utt_id", "left").join(part, "utt_id", "left")
    numbered, clash = F.col("page").isNotNull(), F.coalesce("ambiguous", F.lit(False))
    tier = (F.when(F.col("__sel").isNotNull(), F.struct(F.col("__sel").alias("s"), F.lit(100).alias("p"), F.lit("selection").alias("w")))
            .when(numbered & F.col("__no").isNotNull(), F.struct(F.col("__no").alias("s"), F.lit(95).alias("p"), F.lit("page number").alias("w")))
            .when(numbered, F.struct(F.lit(None).cast("string").alias("s"), F.lit(0).alias("p"), F.lit("no such page").alias("w")))
            .when(clash, F.struct(F.lit(None).cast("string").alias("s"), F.lit(0).alias("p"), F.lit("several titles match").alias("w")))
            .when(F.col("__title").isNotNull(), F.struct(F.col("__title").alias("s"), F.lit(80).alias("p"), F.lit("title").alias("w")))
            .when(F.col("__part").isNotNull(), F.struct(F.col("__part").alias("s"), F.lit(65).alias("p"), F.lit("part of a title").alias("w")))
            .otherwise(F.struct(F.lit(None).cast("string").alias("s"), F.lit(0).alias("p"), F.lit("no page named").alias("w"))))
    return (r.withColumn("__t", tier).withColumn("slide_uid", F.col("__t.s")).withColumn("slide_pct", F.col("__t.p"))
            .withColumn("slide_why", F.col("__t.w")).drop("__t", "__sel", "__no", "__title", "__part", "ambiguous"))


def numbered_body(blocks: DataFrame) -> DataFrame:
    """On-page blocks with their number among all (on_no) and among the texts from the top (body_no), from the end
    (tail_no) and by weakness (weak_no)."""
    on = blocks.filter(F.col("channel") == "slide").withColumn("is_visual", md.is_visual())
    orders = {"body_no": ["block_no"], "tail_no": [F.desc("block_no")], "weak_no": ["pinned", "importance_milli", "block_no"]}
    if scale.large_groups(on, ["slide_uid"]).isEmpty():
        # A window a number, all dealt by the slide: the rows leave once. The visuals are numbered behind the texts.
        text = scale.running_whole(on, ["slide_uid"], ["block_no"], number="on_no").filter("is_visual IS NOT NULL")
        for name, order in orders.items():
            text = scale.running_whole(text, ["slide_uid"], [F.col("is_visual"), *order], number=name)
        return text.withColumns({n: F.when(~F.col("is_visual"), F.col(n)) for n in orders})
    at = {"__c": F.floor(F.col("block_no") / 4096)}
    on = cut_lineage(scale.running(on, ["slide_uid"], at, ["block_no"], number="on_no"))
    text = on.filter(~F.col("is_visual"))
    weak = {"__c1": F.col("pinned").cast("int"), "__c2": F.col("importance_milli"), "__c3": F.floor(F.col("block_no") / 4096)}
    for (name, order), chunk in zip(orders.items(), (at, {"__c": -F.floor(F.col("block_no") / 4096)}, weak), strict=True):
        text = scale.running(text, ["slide_uid"], chunk, order, number=name)
    none = {n: F.lit(None).cast("long") for n in ("body_no", "tail_no", "weak_no")}
    return text.unionByName(on.filter("is_visual").withColumns(none))


def page_facts(slides: DataFrame, blocks: DataFrame) -> DataFrame:
    """What each page holds, by partial aggregation."""
    on = F.col("channel") == "slide"
    body = on & ~md.is_visual()
    per = blocks.groupBy("slide_uid").agg(
        F.count_if(on).alias("n_on"), F.count_if(body).alias("n_body"), F.count_if(body & F.col("pinned")).alias("n_body_pinned"),
        F.bool_or(F.col("asset_ref").isNotNull()).alias("has_asset"))
    return slides.select("slide_uid", F.col("title").alias("page_title"), "dwell_seconds").join(per, "slide_uid", "left").fillna(
        0, ["n_on", "n_body", "n_body_pinned"])


def substitution_targets(requests: DataFrame, slides: DataFrame, blocks: DataFrame) -> DataFrame:
    """(utt_id, op, target, value) of literal substitutions in blocks and titles."""
    old, new = F.regexp_extract("text", q.REPLACE, 1), F.regexp_extract("text", q.REPLACE, 2)
    r = requests.filter(F.col("text").rlike(q.REPLACE)).select("utt_id", "deck_uid", old.alias("old"), new.alias("new"))
    needles = r.select("deck_uid", "old").distinct()

    def hits(df: DataFrame, uid: str, body: str, op: str) -> DataFrame:
        found = scale.contains_join(df.select("deck_uid", uid, body), body, needles, "old", ["deck_uid"])
        return found.join(r, ["deck_uid", "old"]).select(
            "utt_id", F.lit(op).alias("op"), F.col(uid).alias("target"), F.replace(F.col(body), F.col("old"), F.col("new")).alias("value"))

    return hits(blocks.filter("content <> ''"), "block_uid", "content", "set_text").unionByName(
        hits(slides.filter("title <> ''"), "slide_uid", "title", "set_title"))


def request_facts(requests: DataFrame, slides: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row per request with everything the rules look at."""
    r = requests.withColumn("text", tx.strip("text")).withColumn("selection", F.coalesce("selection", F.array().cast("array<string>")))
    sel = selected_blocks(r, slides, blocks).groupBy("utt_id").agg(
        F.count(F.lit(1)).alias("n_sel"), F.count_if("pinned").alias("sel_pinned"), F.count_if(~F.col("is_visual")).alias("sel_text"))
    r = resolve_slide(r, slides, blocks).join(sel, "utt_id", "left").join(page_facts(slides, blocks), "slide_uid", "left")
    r = r.withColumn("n_take", q.count_phrase("text")).withColumn("item", q.ordinal("text", "条")).withColumn(
        "seconds", q.duration_seconds("text"))
    # How many of the last n texts are pinned: exact-number join, only for requests that state a count.
    ask = r.filter("n_take > 0 AND slide_uid IS NOT NULL AND n_sel IS NULL").select(
        "utt_id", "slide_uid", F.explode(F.sequence(F.lit(1), F.least(F.col("n_take").cast("long"), F.col("n_body")))).alias("tail_no"))
    tail = numbered_body(blocks).filter("tail_no IS NOT NULL AND pinned").select("slide_uid", "tail_no")
    pinned = ask.filter("tail_no > 0").join(tail, ["slide_uid", "tail_no"]).groupBy("utt_id").agg(F.count(F.lit(1)).alias("take_pinned"))
    hits = substitution_targets(r, slides, blocks).groupBy("utt_id").agg(F.count(F.lit(1)).alias("n_subst"))
    zero = ["n_sel", "sel_pinned", "sel_text", "take_pinned", "n_subst", "n_on", "n_body", "n_body_pinned"]
    return r.join(pinned, "utt_id", "left").join(hits, "utt_id", "left").fillna(0, zero)


def rule_readings(facts: DataFrame) -> DataFrame:
    """Every rule's reading of every request: utt_id, rule_no, rule, pct, ok."""
    t, low = F.col("text"), F.lower("text")
    sel, page, pct = F.col("n_sel") > 0, F.col("slide_uid").isNotNull(), F.col("slide_pct")
    secs, item = F.col("seconds"), F.col("item")

    def no(p: int) -> Column:
        return F.struct(F.lit(p).alias("pct"), F.lit(False).alias("ok"))

    def yes(p: Column | int) -> Column:
        return F.struct((F.lit(p) if isinstance(p, int) else p).alias("pct"), F.lit(True).alias("ok"))

    def upto(p: int) -> Column:
        return F.least(F.lit(p), pct)

    on_page = q.has(t, q.THIS_PAGE) | F.col("page").isNotNull()
    whole = q.has(t, q.WHOLE_TALK) | ~on_page
    third = F.greatest(F.lit(1), F.floor(F.col("n_body") / 3))
    in_body = F.coalesce(item.between(1, F.col("n_body")), F.lit(False))
    in_page = F.coalesce(item.between(1, F.col("n_on")), F.lit(False))
    title_cue = t.contains("标题") | low.contains("title")
    readings = [
        F.when(t.rlike(q.REPLACE), F.when(F.col("n_subst") > 0, yes(95)).otherwise(no(30))),
        F.when(secs.isNotNull(), F.when(whole & (secs < 60), no(40)).when(whole, yes(95)).when(~page, no(30)).otherwise(yes(upto(92)))),
        F.when(q.has(t, q.TOO_FULL) | q.has(low, q.TO_SCRIPT),
               F.when(sel & (F.col("sel_pinned") > 0), no(50)).when(sel & (F.col("sel_text") == 0), no(40)).when(sel, yes(95))
               .when(~page, no(30)).when(F.col("n_take").isNull() & (F.col("n_body") <= 1), no(40))
               .when(F.col("n_take").isNull() & (third > F.col("n_body") - F.col("n_body_pinned")), no(50))
               .when(F.col("n_take").isNull(), yes(70)).when(F.col("take_pinned") > 0, no(50))
               .when(F.col("n_body") == 0, no(40)).otherwise(yes(90))),
        F.when(q.has(low, q.SHORTEN) & ~(F.coalesce(secs > 0, F.lit(False)) & q.has(t, q.WHOLE_TALK_SHORT)),
               F.when(sel, F.when(F.col("sel_text") > 0, yes(90)).otherwise(no(30))).when(~page, no(30))
               .when(F.col("n_body") == 0, no(30)).otherwise(yes(upto(90)))),
        F.when(title_cue, F.when(~t.rlike(q.QUOTED), no(40)).when(~page, no(30)).otherwise(yes(upto(93)))),
        F.when(q.has(t, q.SPLIT) & ~(q.has(t, q.SPLIT_POINTS) & ~t.contains("页")),
               F.when(~page, no(30)).when(F.col("n_on") < 2, no(40)).otherwise(yes(upto(90)))),
        F.when(q.has(t, q.MERGE), F.when(F.col("n_sel") < 2, no(35)).otherwise(yes(90))),
        F.when(q.has(t, q.DELETE) & ~q.has(t, q.TO_SCRIPT),
               F.when(sel, yes(90)).when(~page, no(30)).when(~in_page, no(35)).otherwise(yes(85))),
        F.when(q.has(t, q.KEEP), F.when(sel, yes(90)).when(~page, no(30)).when(F.col("n_on") == 0, no(30)).otherwise(yes(70))),
        F.when(q.has(t, q.IMPORTANT), F.when(sel, yes(85)).otherwise(no(35))),
        F.when(q.has(t, q.RESERVE), F.when(page, yes(upto(90))).otherwise(no(30))),
        F.when(q.has(t, q.WITH_FIGURE), F.when(~page, no(30)).when(~F.coalesce("has_asset", F.lit(False)), no(50)).otherwise(yes(upto(85)))),
        F.when(q.has(t, q.SPARSER) | q.has(low, q.SPARSER) | q.has(t, q.DENSER) | q.has(low, q.DENSER), yes(85)),
    ]
    rows = F.array(*[F.when(c.isNotNull(), F.struct(F.lit(i + 1).alias("rule_no"), F.lit(RULES[i]).alias("rule"),
                                                    c["pct"].alias("pct"), c["ok"].alias("ok"))) for i, c in enumerate(readings)])
    return facts.filter("text <> ''").select("*", F.explode(F.array_compact(rows)).alias("r")).select(
        *facts.columns, "r.rule_no", "r.rule", "r.pct", "r.ok")


def interpret(facts: DataFrame) -> DataFrame:
    """One reading per request: the first sure rule, else the most confident, else none."""
    read = rule_readings(facts).select("utt_id", "rule_no", "rule", "pct", "ok")
    sure = F.col("ok") & (F.col("pct") >= SURE)
    key = F.struct((~sure).alias("a"), F.when(sure, F.lit(0)).otherwise(-F.col("pct")).alias("b"), F.col("rule_no").alias("c"))
    best = read.groupBy("utt_id").agg(F.min_by(F.struct("rule", "pct", "ok"), key).alias("b"))
    none = F.when(F.col("text") == "", "empty request").otherwise("no rule matched")
    return facts.join(best, "utt_id", "left").select(
        "utt_id", "deck_uid", F.coalesce("b.rule", none).alias("rule"), F.coalesce("b.pct", F.lit(0)).alias("confidence_pct"),
        F.coalesce("b.ok", F.lit(False)).alias("ok"))


def propose(facts: DataFrame, chosen: DataFrame, slides: DataFrame, blocks: DataFrame) -> DataFrame:
    """The edits of the chosen readings: utt_id, op, target, value."""
    # Some twenty kinds of edit read these two tables, so both are written once.
    win = cut_lineage(facts.join(chosen.filter("ok").select("utt_id", "rule"), "utt_id"))
    body = cut_lineage(numbered_body(blocks.join(win.select("slide_uid"), "slide_uid", "left_semi")))
    t = F.col("text")

    def rows(df: DataFrame, op: Column | str, target: Column | str, value: Column | str | None) -> DataFrame:
        return df.select("utt_id", (F.lit(op) if isinstance(op, str) else op).alias("op"),
                         tx.col(target).cast("string").alias("target"),
                         (F.lit(value) if value is None or isinstance(value, str) else value).cast("string").alias("value"))

    def of(rule: str) -> DataFrame:
        return win.filter(F.col("rule") == rule)

    on_page = q.has(t, q.THIS_PAGE) | F.col("page").isNotNull()
    whole = q.has(t, q.WHOLE_TALK) | ~on_page
    more, less, now = q.has(t, q.MORE_TIME), q.has(t, q.LESS_TIME), F.col("dwell_seconds")
    moved = F.when((more | less) & (now > 0), F.when(more, now + F.col("seconds")).otherwise(
        F.greatest(F.lit(5.0), now - F.col("seconds")))).otherwise(F.col("seconds").cast("double"))
    retime = of("retime")
    out = [rows(retime.filter(whole), "retime", "deck_uid", F.col("seconds")),
           rows(retime.filter(~whole), "set_dwell", "slide_uid", moved),
           rows(of("set_title"), "set_title", "slide_uid", F.regexp_extract("text", q.QUOTED, 1)),
           rows(of("backup"), "set_backup", "slide_uid", F.when(q.has(t, q.OUT_OF_RESERVE), "false").otherwise("true")),
           rows(of("figure_layout"), "set_slide_role", "slide_uid", "text_figure"),
           rows(of("density"), "retime", "deck_uid", F.when(q.has(t, q.SPARSER) | q.has(F.lower("text"), q.SPARSER), "sparse")
                .otherwise("compact"))]
    subst = substitution_targets(of("replace_text").select("utt_id", "deck_uid", "text"), slides, blocks)
    out.append(subst.select("utt_id", "op", "target", "value"))
    # Edits on selected blocks.
    picked = selected_blocks(win.filter("n_sel > 0").select("utt_id", "deck_uid", "selection"), slides, blocks)
    p = picked.join(win.select("utt_id", "rule"), "utt_id")
    out += [rows(p.filter("rule = 'declutter' AND NOT is_visual"), "set_channel", "block_uid", "script"),
            rows(p.filter("rule = 'shorten' AND NOT is_visual"), "rewrite", "block_uid", None),
            rows(p.filter("rule = 'delete'"), "delete_block", "block_uid", "drop"),
            rows(p.filter("rule = 'pin'"), "pin", "block_uid", "true"),
            rows(p.filter("rule = 'emphasise'"), "set_importance", "block_uid", "1000"),
            rows(p.filter("rule = 'emphasise'"), "pin", "block_uid", "true")]
    first = p.filter("rule = 'merge'").groupBy("utt_id").agg(F.min_by("block_uid", F.struct("pick_no", "block_no")).alias("target"))
    rest = p.filter("rule = 'merge'").join(first, "utt_id").filter("block_uid <> target")
    out.append(rows(rest, "merge_blocks", "target", F.col("block_uid")))
    # Edits on blocks named by their place on the page: joined on that place.
    free = win.filter("n_sel = 0")
    n_last = F.least(F.col("n_take").cast("long"), F.col("n_body"))
    third = F.greatest(F.lit(1), F.floor(F.col("n_body") / 3)).cast("long")

    def at(df: DataFrame, number: str, upto: Column, op: str, value: str | None) -> DataFrame:
        want = df.filter(upto > 0).select("utt_id", "slide_uid", F.explode(F.sequence(F.lit(1).cast("long"), upto)).alias(number))
        return rows(want.join(body.filter(F.col(number).isNotNull()).select("slide_uid", number, "block_uid"), ["slide_uid", number]),
                    op, "block_uid", value)

    def nth(df: DataFrame, number: str, n: Column, op: str, value: str | None) -> DataFrame:
        want = df.select("utt_id", "slide_uid", n.cast("long").alias(number))
        return rows(want.join(body.filter(F.col(number).isNotNull()).select("slide_uid", number, "block_uid"), ["slide_uid", number]),
                    op, "block_uid", value)

    listed = F.coalesce(F.col("item").between(1, F.col("n_body")), F.lit(False))
    tidy_up, short, cut = free.filter("rule = 'declutter'"), free.filter("rule = 'shorten'"), of("split_slide")
    out += [at(tidy_up.filter("n_take IS NOT NULL"), "tail_no", n_last, "set_channel", "script"),
            at(tidy_up.filter("n_take IS NULL"), "weak_no", third, "set_channel", "script"),
            nth(short.filter(listed), "body_no", F.col("item"), "rewrite", None),
            at(short.filter(~listed), "body_no", F.col("n_body"), "rewrite", None),
            nth(free.filter("rule = 'delete'"), "on_no", F.col("item"), "delete_block", "drop"),
            at(free.filter("rule = 'pin'"), "on_no", F.col("n_on"), "pin", "true")]
    mid = cut.select("utt_id", "slide_uid", (F.floor((F.col("n_on") - 1) / 2) + 1).cast("long").alias("on_no"))
    split = mid.join(body.select("slide_uid", "on_no", "block_uid"), ["slide_uid", "on_no"])
    out.append(rows(split, "split_slide", "slide_uid", F.col("block_uid")))
    edits = out[0]
    for part in out[1:]:
        edits = edits.unionByName(part)
    # A rewrite aims at two thirds of the budget, else of the present length.
    goal = blocks.select(F.col("block_uid").alias("target"), F.floor(F.coalesce(
        F.col("word_budget"), tx.count_units("content")) * 67 / 100).cast("string").alias("__goal"))
    plain, cutdown = edits.filter("op <> 'rewrite'"), edits.filter("op = 'rewrite'")
    return plain.unionByName(cutdown.join(goal, "target", "left").select(
        "utt_id", "op", "target", F.nullif("__goal", F.lit("0")).alias("value")))
