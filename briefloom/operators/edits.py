"""The edit log: final values, validity, blast radius, structural edits, fingerprints and diffs.

``ops``: deck_uid, seq, op_no, patch_id, op, target, value (and further argument columns per kind). A patch is the
rows of one (deck_uid, patch_id). Order is (seq, op_no), never the clock.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from briefloom import scale
from briefloom.functions import text as tx
from briefloom.operators import model as md

# What each edit writes, needs and triggers.
FIELD = {"set_text": "content", "delete_block": "channel", "set_channel": "channel", "set_importance": "importance",
         "pin": "pinned", "set_dwell": "dwell_seconds", "retime": "total_seconds", "set_slide_role": "role",
         "set_backup": "is_backup", "set_title": "title", "set_caption": "caption", "set_style": "tags", "replace_asset": "asset_ref"}
NEEDS_BLOCK = ("set_text", "rewrite", "split_block", "merge_blocks", "delete_block", "set_channel", "set_importance",
               "pin", "move_block", "replace_asset", "set_style")
NEEDS_SLIDE = ("set_dwell", "split_slide", "set_slide_role", "set_backup")
REALLOCATES = ("set_channel", "set_importance", "set_dwell", "retime", "move_block", "split_slide", "set_slide_role",
               "set_backup")
AUTO_APPLY_PCT = 75


def _order() -> Column:
    return F.struct("seq", "op_no")


def latest_values(ops: DataFrame) -> DataFrame:
    """Final value of every (deck, target, field): the last writer wins. Combines on the map side, so a target with
    any number of edits leaves each task as one row."""
    fields = F.create_map(*[F.lit(x) for kv in FIELD.items() for x in kv])
    value = F.when(F.col("op") == "delete_block", "drop").otherwise(F.col("value"))  # a deletion says no value
    return (ops.withColumn("field", fields[F.col("op")]).filter("field IS NOT NULL")
            .groupBy("deck_uid", "target", "field").agg(
                F.max_by(value, _order()).alias("value"), F.max("seq").alias("seq"),
                F.count(F.lit(1)).alias("edits")))


def latest_arguments(ops: DataFrame, arguments: Sequence[str]) -> DataFrame:
    """The last value given for each argument of a target's edits; an edit that leaves one out does not clear it."""
    last = [F.max_by(a, F.when(F.col(a).isNotNull(), _order())).alias(a) for a in arguments]
    return ops.groupBy("target").agg(*last)


def truncate_after(ops: DataFrame, cuts: DataFrame) -> DataFrame:
    """Drop everything after the named patch of each deck (``cuts``: deck_uid, patch_id)."""
    at = ops.join(cuts, ["deck_uid", "patch_id"]).groupBy("deck_uid").agg(F.max("seq").alias("__at"))
    return ops.join(at, "deck_uid", "left").filter(F.col("__at").isNull() | (F.col("seq") <= F.col("__at"))).drop("__at")


def unknown_cuts(ops: DataFrame, cuts: DataFrame) -> DataFrame:
    """Cuts naming a patch their deck does not have: an error row each."""
    return cuts.join(ops.select("deck_uid", "patch_id"), ["deck_uid", "patch_id"], "left_anti")


def affected(ops: DataFrame) -> DataFrame:
    """Distinct (deck, patch, uid) a patch declares: targets and, where given, others / to_slide / order / asset."""
    more = [F.array(F.col(c).cast("string")) for c in ("to_slide", "after_block", "asset_ref") if c in ops.columns]
    more += [F.transform(c, lambda x: x.cast("string")) for c in ("others", "order") if c in ops.columns]
    empty = F.array().cast("array<string>")
    every = F.concat(F.array(F.col("target").cast("string")), *[F.coalesce(m, empty) for m in more])
    return ops.select("deck_uid", "patch_id", F.explode(F.array_compact(every)).alias("uid")).distinct()


def needs_reallocation(ops: DataFrame) -> DataFrame:
    return ops.groupBy("deck_uid").agg(F.bool_or(F.col("op").isin(*REALLOCATES)).alias("reallocate"),
                                       F.countDistinct("patch_id").alias("patches"))


def history(ops: DataFrame) -> DataFrame:
    """Numbered patches of each deck with their time and utterance, or how many edits they hold."""
    p = ops.groupBy("deck_uid", "patch_id", "seq").agg(
        F.min("created_at").alias("created_at"), F.max("utterance").alias("utterance"), F.count(F.lit(1)).alias("n"))
    numbered = scale.running(p, ["deck_uid"], scale.position_chunk("seq"), ["seq"], number="no")
    label = F.coalesce(F.nullif("utterance", F.lit("")), F.concat(F.col("n"), F.lit(" op(s)")))
    return numbered.select("deck_uid", "no", "patch_id", F.date_format("created_at", "HH:mm:ss").alias("time"),
                           label.alias("label"))


def confidence_gate(patches: DataFrame, threshold_pct: int = AUTO_APPLY_PCT) -> DataFrame:
    """Adds decision: apply, confirm or refuse (no edit proposed)."""
    c = F.col("confidence_pct")
    return patches.withColumn("decision", F.when(F.col("op").isNull(), "refuse").when(c >= threshold_pct, "apply")
                              .otherwise("confirm"))


def confirmation_rate(patches: DataFrame) -> DataFrame:
    """Share of readings below the bar, per deck."""
    return patches.groupBy("deck_uid").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(
        (F.col("confidence_pct") < AUTO_APPLY_PCT).cast("double")), 4).alias("needs_confirmation"))


# -------------------------------------------------------------------- validity


def reject_invalid(ops: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid ops, failed ops with reason). A patch with one bad edit is refused whole.

    ``nodes``: deck_uid, uid, kind, is_visual. Validity against the tables as given; edits that depend on earlier
    structural edits of the same target are judged when those have been applied.
    """
    n = nodes.select("deck_uid", F.col("uid").alias("target"), "kind", "is_visual")
    j = ops.join(n, ["deck_uid", "target"], "left")
    kind, op = F.col("kind"), F.col("op")
    reason = (F.when((op == "retime") & (kind != "deck"), "retime targets the deck")
              .when(kind.isNull(), "no such node")
              .when(op.isin(*NEEDS_BLOCK) & (kind != "block"), F.concat(kind, F.lit(" where a block is needed")))
              .when(op.isin(*NEEDS_SLIDE) & (kind != "slide"), F.concat(kind, F.lit(" where a slide is needed")))
              .when(op.isin("reorder_slides") & (kind != "section"), F.concat(kind, F.lit(" where a section is needed")))
              .when((op == "insert_block") & ~kind.isin("block", "slide"), F.concat(kind, F.lit(" where a block or slide is needed")))
              .when((op == "set_channel") & F.col("is_visual") & (F.col("value") == "script"), "a visual cannot be spoken")
              .when((op == "set_text") & (tx.strip(F.coalesce("value", F.lit(""))) == ""), "empty text")
              .when((op == "set_importance") & ~F.col("value").cast("double").between(0, 1000), "importance out of range")
              .when((op == "set_dwell") & ~(F.col("value").cast("double") > 0), "seconds must be positive")
              .when((op == "replace_asset") & ~F.col("is_visual"), "not a figure or table block")
              .when((op == "set_title") & ~kind.isin("slide", "section"), "cannot set a title here")
              .when((op == "set_caption") & ~(kind.isin("asset") | F.col("is_visual")), "cannot set a caption here"))
    judged = j.withColumn("reason", reason)
    bad = judged.filter("reason IS NOT NULL")
    refused = bad.select("deck_uid", "patch_id").distinct()
    return ops.join(refused, ["deck_uid", "patch_id"], "left_anti"), bad.select(*ops.columns, "reason")


# ---------------------------------------------------------------- set-wise edits


def set_column(blocks: DataFrame, latest: DataFrame, field: str, column: str, cast: str, key: str = "block_uid") -> DataFrame:
    """Overwrite one column from the latest values of one field."""
    v = latest.filter(F.col("field") == field).select(F.col("target").alias(key), F.col("value").cast(cast).alias("__v"))
    return blocks.join(v, key, "left").withColumn(column, F.coalesce("__v", column)).drop("__v")


def set_text(blocks: DataFrame, ops: DataFrame) -> DataFrame:
    """Hand-written text is no longer the source's words: verbatim and compressed become authored.

    A caption given to a block is its text too, but says nothing about whose words they are."""
    by_hand = F.bool_or(F.col("op") == "set_text") if "op" in ops.columns else F.lit(True)
    v = ops.groupBy(F.col("target").alias("block_uid")).agg(F.max_by("value", _order()).alias("__v"), by_hand.alias("__h"))
    j = blocks.join(v, "block_uid", "left")
    owned = F.coalesce("__h", F.lit(False)) & F.col("derivation").isin("verbatim", "compressed")
    return (j.withColumn("derivation", F.when(owned, "authored").otherwise(F.col("derivation")))
            .withColumn("content", F.coalesce("__v", "content")).drop("__v", "__h"))


def rewrite(blocks: DataFrame, ops: DataFrame) -> DataFrame:
    """Shorten blocks in place. ``ops``: target, max_units (nullable), preserve_spans.

    Trim first; where no prefix fits, the first point stays and the rest joins the spoken note. Adds outcome.
    """
    r = ops.select(F.col("target").alias("block_uid"), F.col("max_units").alias("__max"),
                   F.col("preserve_spans").alias("__keep"), F.lit(True).alias("__hit"))
    b = blocks.join(r, "block_uid", "left").withColumn("__limit", F.coalesce("__max", "word_budget"))
    limit = F.col("__limit")
    b = b.withColumn("__cut", F.when(F.col("__hit") & (limit > 0), F.struct(tx.shorten_to("content", limit).alias("short"))))
    give_up = F.col("__cut.short") == F.col("content")
    # Points are only made of what no cut could shorten.
    b = b.withColumn("__ht", F.when(give_up, tx.head_and_tail("content", limit)))
    new = (F.when(~F.coalesce("__hit", F.lit(False)), F.col("content"))
           .when(F.col("__cut").isNull(), tx.leading_clause("content"))
           .when(give_up, F.col("__ht.head")).otherwise(F.col("__cut.short")))
    spill = F.when(give_up & (F.col("__ht.head") != F.col("content")), F.col("__ht.tail"))
    note = F.when(F.coalesce(spill, F.lit("")) != "", F.when(F.col("speaker_note").isNotNull(), tx.strip(
        F.concat_ws(" ", spill, "speaker_note"))).otherwise(spill)).otherwise(F.col("speaker_note"))
    b = b.withColumn("__new", new).withColumn("speaker_note", note)
    changed = F.coalesce(F.col("__hit"), F.lit(False)) & (F.col("__new") != F.col("content"))
    outcome = (F.when(changed, "rewritten").when(F.col("__hit") & (tx.count_units("content") > limit), "no clean cut")
               .when(F.col("__hit"), "already fits"))
    derivation = F.when(changed, F.when(F.col("__keep") & (F.size("spans") > 0), "compressed").otherwise("authored"))
    return (b.withColumn("outcome", outcome).withColumn("derivation", F.coalesce(derivation, "derivation"))
            .withColumn("content", F.col("__new")).drop("__max", "__keep", "__hit", "__limit", "__cut", "__ht", "__new"))


def _renumber(blocks: DataFrame, order: Sequence[str], whole: bool = False) -> DataFrame:
    """block_no from the given order columns; chunks follow the old positions. ``whole``: no slide is too large for one task."""
    if whole:
        return scale.running_whole(blocks.drop("block_no"), ["slide_uid"], [*order, "block_uid"], number="block_no").drop(*order)
    chunk = {"__chunk": F.floor(F.col(order[0]) / 4096)}
    numbered = scale.running(blocks.drop("block_no"), ["slide_uid"], chunk, [*order, "block_uid"], number="block_no")
    return numbered.drop(*order)


def split_blocks(blocks: DataFrame, ops: DataFrame, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Blocks cut into parts, the clones right behind their original; (blocks, refused ops).

    ``ops``: target, parts (nullable array). Without parts the sentences decide; fewer than two is an error.
    """
    o = ops.select(F.col("target").alias("block_uid"), F.col("parts").alias("__parts"), F.lit(True).alias("__hit"))
    b = blocks.join(o, "block_uid", "left")
    given = F.filter(F.transform(F.coalesce("__parts", tx.sentences("content")), tx.strip), lambda p: p != "")
    b = b.withColumn("__p", F.when(F.col("__hit"), given))
    refused = b.filter(F.col("__hit") & (F.size("__p") < 2)).select(F.col("block_uid").alias("target"))
    parts = F.when(F.col("__hit") & (F.size("__p") >= 2), F.col("__p")).otherwise(F.array("content"))
    rows = b.withColumn("__old", F.col("block_no")).select(
        *[c for c in b.columns if not c.startswith("__")], "__old", F.posexplode(parts).alias("__part", "__text"))
    uid = F.when(F.col("__part") == 0, F.col("block_uid")).otherwise(md.mint_uid("block", "block_uid", "__part"))
    rows = rows.withColumn("content", F.col("__text")).withColumn("block_uid", uid).drop("__text")
    return _renumber(rows, ["__old", "__part"], whole), refused


def merge_blocks(blocks: DataFrame, ops: DataFrame, separator: str = "; ", whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Blocks joined into their target on one slide; (blocks, refused ops).

    ``ops``: op_id, target, others (array). The joined text is as long as one edit's list, so it gathers per edit. What an edit
    names is looked up by uid alone; texts move once, to the blocks of their slide.
    """
    between = F.coalesce("separator", F.lit(separator)) if "separator" in ops.columns else F.lit(separator)
    ops = ops.withColumn("__sep", between)
    listed = ops.select("op_id", "target", "__sep", F.posexplode(F.concat(F.array("target"), "others")).alias("k", "block_uid"))
    homes = blocks.groupBy("block_uid").agg(F.min("slide_uid").alias("__from"), F.max("slide_uid").alias("__to"),
                                            F.bool_or(F.col("slide_uid").isNull()).alias("__lost"))
    per = listed.join(homes, "block_uid", "left").groupBy("op_id", "target").agg(
        F.first("__sep").alias("sep"), F.min("__from").alias("slide_uid"), F.max("__to").alias("__to"),
        F.bool_or(F.coalesce("__lost", F.lit(True))).alias("__lost"), F.collect_list(F.struct("k", "block_uid")).alias("l"))
    ok = ~F.col("__lost") & (F.col("slide_uid") == F.col("__to"))
    refused = per.filter(~F.coalesce(ok, F.lit(False))).select("op_id", "target")
    named = F.transform(F.array_distinct("l"), lambda x: F.struct(x["block_uid"].alias("block_uid"), x["k"].alias("k"), F.size(F.filter(
        "l", lambda y: (y["k"] == x["k"]) & y["block_uid"].eqNullSafe(x["block_uid"]))).alias("times")))
    roles = per.filter(ok).select("op_id", "target", "sep", "slide_uid", F.explode(named).alias("x")).select(
        "slide_uid", "x.block_uid", F.struct("op_id", "target", "sep", "x.k", "x.times").alias("__role"))

    old = blocks.withColumn("__old", F.col("block_no")).drop("block_no")
    if whole:
        return _renumber(_merged_on_slides(old, roles), ["__old"], whole), refused
    listed_large = F.broadcast(scale.large_groups(blocks, ["slide_uid"]))
    mine = F.struct(F.col("slide_uid").alias("k0")) == F.col("__large")
    few = _merged_on_slides(old.join(listed_large, mine, "left_anti"), roles.join(listed_large, mine, "left_anti"))
    many = _merged_by_uid(old.join(listed_large, mine, "left_semi"), roles.join(listed_large, mine, "left_semi"))
    numbered = _renumber(few, ["__old"], whole=True)
    chunked = _renumber(many.withColumn("block_no", F.col("__old")), ["__old"])
    return numbered.unionByName(chunked.select(*numbered.columns)), refused


def _with_joined_text(hits: DataFrame, l: Column, sep: Column, hit: Column) -> DataFrame:
    """The target's row with the texts of ``l`` (k, content, spans, in order) joined and its spans united."""
    text = F.concat_ws("", F.transform(l, lambda x, i: F.concat(F.when(i > 0, sep).otherwise(""), x["content"])))
    out = hits.withColumn("__c", F.when(hit, text)).withColumn("__s", F.when(hit, F.array_distinct(F.flatten(F.transform(l, lambda x: x["spans"])))))
    return (out.withColumn("content", F.coalesce("__c", "content")).withColumn("spans", F.coalesce("__s", "spans"))
            .withColumn("derivation", F.when(F.col("__c").isNotNull() & (F.size("spans") > 1), "synthesized").otherwise(F.col("derivation")))
            .drop("__c", "__s"))


def _merged_on_slides(blocks: DataFrame, roles: DataFrame) -> DataFrame:
    """Blocks and their roles dealt by slide, once: windows inside a slide bring them together."""
    both = blocks.withColumn("__is", F.lit(True)).unionByName(roles, allowMissingColumns=True).repartition("slide_uid")
    met = both.withColumn("__roles", F.collect_list("__role").over(Window.partitionBy("slide_uid", "block_uid"))).filter("__is").drop("__role", "__is")
    met = met.withColumn("__gone", F.exists("__roles", lambda r: r["k"] > 0)).select(
        *[c for c in met.columns if c != "__roles"], "__gone", F.explode_outer("__roles").alias("__r"))
    r = F.col("__r")
    piece = F.when(r.isNotNull(), F.array_repeat(F.struct(r["k"].alias("k"), F.col("content"), F.col("spans")), r["times"]))
    op = Window.partitionBy("slide_uid", "__op", "__target")
    met = met.withColumns({"__op": r["op_id"], "__target": r["target"]}).withColumn("__piece", piece)
    met = met.withColumn("__l", F.array_sort(F.flatten(F.collect_list("__piece").over(op)))).filter(~F.col("__gone")).drop("__piece", "__gone", "__op", "__target")
    return _with_joined_text(met, F.col("__l"), r["sep"], r.isNotNull()).drop("__l", "__r")


def _merged_by_uid(blocks: DataFrame, roles: DataFrame) -> DataFrame:
    """The same where slides are too large to stand in one task."""
    flat = roles.select("block_uid", "__role.*")
    texts = flat.join(blocks.select("block_uid", "content", "spans"), "block_uid").withColumn("__piece", F.array_repeat(F.struct("k", "content", "spans"), F.col("times")))
    l = texts.groupBy("op_id", F.col("target").alias("block_uid")).agg(F.first("sep").alias("__sep"), F.array_sort(F.flatten(F.collect_list("__piece"))).alias("__l"))
    left = blocks.join(flat.filter("k > 0").select("block_uid"), "block_uid", "left_anti").join(l.drop("op_id"), "block_uid", "left")
    return _with_joined_text(left, F.col("__l"), F.col("__sep"), F.col("__l").isNotNull()).drop("__l", "__sep")


def renumber_blocks(blocks: DataFrame, whole: bool = False) -> DataFrame:
    """Positions without gaps, in the order the blocks have."""
    return _renumber(blocks.withColumn("__old", F.col("block_no")), ["__old"], whole)


def delete_blocks(blocks: DataFrame, ops: DataFrame, whole: bool = False) -> DataFrame:
    """Soft deletes move to the drop channel, hard ones leave the table. ``ops``: target, hard."""
    per = ops.groupBy(F.col("target").alias("block_uid")).agg(F.bool_or("hard").alias("__hard"))
    b = blocks.join(per, "block_uid", "left").withColumn("__old", F.col("block_no"))
    b = b.filter(~F.coalesce("__hard", F.lit(False))).withColumn(
        "channel", F.when(F.col("__hard").isNotNull(), "drop").otherwise(F.col("channel"))).drop("__hard")
    return _renumber(b, ["__old"], whole)


def insert_blocks(blocks: DataFrame, ops: DataFrame, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """New blocks before or after another, or at the end of a slide; (blocks, refused ops).

    ``ops``: op_id, target (block or slide), position, content, type, derivation, spans. Text without a source must
    say it is authored or inferred.
    """
    dishonest = (F.size("spans") == 0) & ~F.col("derivation").isin("authored", "inferred")
    bad = ops.filter(dishonest).select("op_id", "target")
    good = ops.filter(~dishonest)
    at_block = blocks.select(F.col("block_uid").alias("target"), "slide_uid", F.col("block_no").alias("__at"))
    by_block = good.join(at_block, "target")
    ends = blocks.groupBy("slide_uid").agg(F.max("block_no").alias("__at"))
    by_slide = good.join(ends.withColumnRenamed("slide_uid", "target"), "target").withColumn("slide_uid", F.col("target"))
    tail = F.when(F.col("position") == "before", -1).otherwise(1)
    last = by_block.filter("position = 'append'").drop("__at").join(ends, "slide_uid")
    new = (by_block.filter("position <> 'append'").unionByName(last).unionByName(by_slide)
           .withColumn("__side", tail).withColumn("block_uid", md.mint_uid("block", "target", "op_id")))
    rows = blocks.withColumn("__at", F.col("block_no")).withColumn("__side", F.lit(0)).withColumn("__op", F.lit(0).cast("long"))
    new = new.withColumn("__op", F.col("op_id").cast("long")).drop("op_id", "target", "position")
    lost = good.join(new.select("block_uid"), md.mint_uid("block", "target", "op_id") == F.col("block_uid"), "left_anti")
    return (_renumber(rows.unionByName(new, allowMissingColumns=True), ["__at", "__side", "__op"], whole),
            bad.unionByName(lost.select("op_id", "target")))


def move_blocks(blocks: DataFrame, ops: DataFrame, whole: bool = False) -> DataFrame:
    """Blocks moved to another slide at an index, the end when none is given or it lies beyond. ``ops``: target,
    to_slide, index."""
    m = ops.select(F.col("target").alias("block_uid"), F.col("to_slide").alias("__to"), F.col("index").alias("__ix"))
    b = blocks.join(m, "block_uid", "left")
    moved = F.col("__to").isNotNull()
    big = F.lit(2 ** 40)
    b = (b.withColumn("__old", F.when(moved, F.coalesce(F.col("__ix").cast("long"), big)).otherwise(F.col("block_no")))
         .withColumn("__late", (~moved).cast("int")).withColumn("slide_uid", F.coalesce("__to", "slide_uid")))
    # A block placed at index i stands after i others, so it goes behind position i.
    b = b.withColumn("__late", F.when(moved, 1).otherwise(0)).drop("__to", "__ix")
    return _renumber(b, ["__old", "__late"], whole)


def reorder_slides(slides: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Slides of a section in the listed order; (slides, refused ops with omitted and foreign counts).

    ``ops``: target (section_uid), order (array of slide_uid). The list must name exactly the section's slides.
    """
    listed = ops.select(F.col("target").alias("section_uid"), F.posexplode(F.array_distinct("order")).alias("__k", "slide_uid"))
    mine = slides.select("section_uid", "slide_uid")
    touched = mine.join(ops.select(F.col("target").alias("section_uid")).distinct(), "section_uid", "left_semi")
    both = touched.withColumn("__in", F.lit(1)).join(listed.withColumn("__l", F.lit(1)), ["section_uid", "slide_uid"],
                                                     "full_outer")
    check = both.groupBy("section_uid").agg(F.count_if(F.col("__l").isNull()).alias("omitted"),
                                            F.count_if(F.col("__in").isNull()).alias("foreign"))
    bad = check.filter("omitted > 0 OR foreign > 0")
    fine = listed.join(bad, "section_uid", "left_anti").withColumn("__k", F.col("__k") + 1)
    out = slides.join(fine, ["section_uid", "slide_uid"], "left").withColumn(
        "slide_no", F.coalesce(F.col("__k").cast("long"), "slide_no")).drop("__k")
    return out, bad.withColumnRenamed("section_uid", "target")


def split_slides(slides: DataFrame, blocks: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Slides cut after a block: the tail goes to a new page right behind; (slides, blocks, refused ops).

    ``ops``: target (slide_uid), after_block.
    """
    at = blocks.select(F.col("slide_uid").alias("target"), F.col("block_uid").alias("after_block"),
                       F.col("block_no").alias("__cut"))
    last = blocks.groupBy(F.col("slide_uid").alias("target")).agg(F.max("block_no").alias("__last"))
    j = ops.join(at, ["target", "after_block"], "left").join(last, "target", "left")
    ok = F.col("__cut").isNotNull() & (F.col("__cut") < F.col("__last"))
    refused = j.filter(~F.coalesce(ok, F.lit(False))).select("target", "after_block")
    cut = j.filter(ok).select(F.col("target").alias("slide_uid"), "__cut")
    kind = slides.schema["slide_uid"].dataType.simpleString()
    fresh = md.mint_uid("slide", "slide_uid", "__cut")
    if kind != "string":
        raise ValueError("slide uids must be strings to mint new pages")
    b = blocks.join(cut, "slide_uid", "left")
    b = b.withColumn("__tail", F.coalesce(F.col("block_no") > F.col("__cut"), F.lit(False)))
    tail = F.col("__tail")
    b = b.withColumn("block_no", F.when(tail, F.col("block_no") - F.col("__cut")).otherwise(F.col("block_no"))).withColumn(
        "slide_uid", F.when(tail, fresh).otherwise(F.col("slide_uid"))).drop("__cut", "__tail")
    new = slides.join(cut, "slide_uid").withColumn("slide_uid", fresh).withColumn("title", tx.continued_title("title"))
    new = new.withColumn("slide_no", F.col("slide_no") + F.lit(0.5)).drop("__cut")
    return slides.withColumn("slide_no", F.col("slide_no").cast("double")).unionByName(new), b, refused


def set_style(blocks: DataFrame, ops: DataFrame) -> DataFrame:
    """Replace size and emphasis tags. ``ops``: seq, op_no, target, font_size_pt, emphasis."""
    last = ops.groupBy(F.col("target").alias("block_uid")).agg(F.max_by(F.struct("font_size_pt", "emphasis"), _order()).alias("__s"))
    size = F.regexp_replace(F.col("__s.font_size_pt").cast("string"), r"\.0$", "")
    new = F.array_compact(F.array(
        F.when(F.col("__s.font_size_pt").isNotNull(), F.concat(F.lit("size:"), size)),
        F.when(F.col("__s.emphasis").isNotNull() & (F.col("__s.emphasis") != "none"), F.concat(F.lit("emphasis:"), "__s.emphasis"))))
    kept = F.filter("tags", lambda t: ~t.startswith("size:") & ~t.startswith("emphasis:"))
    return (blocks.join(last, "block_uid", "left").withColumn(
        "tags", F.when(F.col("__s").isNotNull(), F.concat(kept, new)).otherwise(F.col("tags"))).drop("__s"))


def replace_assets(blocks: DataFrame, ops: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks shown with another asset; (blocks, refused ops). The asset must exist and the block be visual."""
    known = ops.join(assets.select(F.col("asset_uid").alias("asset_ref")), "asset_ref", "left_semi")
    o = known.groupBy(F.col("target").alias("block_uid")).agg(F.max_by("asset_ref", _order()).alias("__a"))
    b = blocks.join(o, "block_uid", "left")
    out = b.withColumn("asset_ref", F.when(md.is_visual() & F.col("__a").isNotNull(), F.col("__a")).otherwise(F.col("asset_ref")))
    missing = ops.join(assets.select(F.col("asset_uid").alias("asset_ref")), "asset_ref", "left_anti").select("target", "asset_ref")
    plain = known.join(blocks.filter(~md.is_visual()).select(F.col("block_uid").alias("target")), "target", "left_semi").select(
        "target", "asset_ref")
    return out.drop("__a"), missing.unionByName(plain)


# ---------------------------------------------------------------- fingerprints


def _digest(*cols: Column | str) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(tx.col(c).cast("string"), F.lit("~")) for c in cols]), 256), 1, 16)


def fingerprints(df: DataFrame, uid: str, fields: Sequence[str]) -> DataFrame:
    """(uid, digest) of the nodes' own fields."""
    return df.select(F.col(uid).cast("string").alias("uid"), _digest(*fields).alias("digest"))


def child_digests(children: DataFrame, parent: str, child: str, position: str) -> DataFrame:
    """(uid, children): an order-aware digest of a parent's child list.

    Each child contributes a hash of its place and uid, and the contributions are summed: partial sums combine on the
    map side, so a parent of any size never meets in one task."""
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.col(position), F.col(child)), 256), 1, 8), 16, 10).cast("decimal(20,0)")
    per = children.groupBy(parent).agg(F.sum(h).cast("string").alias("children"))
    return per.select(F.col(parent).cast("string").alias("uid"), "children")


def node_fingerprints(slides: DataFrame, blocks: DataFrame, slide_fields: Sequence[str], block_fields: Sequence[str]) -> DataFrame:
    own = fingerprints(slides, "slide_uid", slide_fields)
    kids = child_digests(blocks, "slide_uid", "block_uid", "block_no")
    s = own.join(kids, "uid", "left").select("uid", _digest("digest", F.coalesce("children", F.lit("0"))).alias("digest"))
    return s.unionByName(fingerprints(blocks, "block_uid", block_fields))


def fingerprint_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Nodes changed, created or removed between two states."""
    packed = F.coalesce(F.unhex("digest"), F.encode("digest", "utf-8"))  # half as long to move
    j = before.select("uid", packed.alias("b")).join(after.select("uid", packed.alias("a")), "uid", "full_outer")
    change = F.when(F.col("b").isNull(), "created").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return j.select("uid", change.alias("change")).filter("change IS NOT NULL")


def containment_violations(before: DataFrame, after: DataFrame, declared: DataFrame, parents: DataFrame) -> DataFrame:
    """Nodes changed or removed that no edit declared.

    ``declared``: uid. ``parents``: uid, ancestor. The containers of nodes created or removed change with them."""
    ch = fingerprint_changes(before, after)
    moved = ch.filter("change IN ('created', 'removed')").select("uid")
    allowed = declared.select("uid").unionByName(moved).unionByName(
        parents.join(moved, "uid", "left_semi").select(F.col("ancestor").alias("uid")))
    return ch.filter("change <> 'created'").join(allowed, "uid", "left_anti")


def apply_report(changes: DataFrame, declared: DataFrame) -> DataFrame:
    """Changed, added and removed counts per patch. ``declared``: patch_id, uid."""
    return declared.join(changes, "uid").groupBy("patch_id").agg(
        *[F.count_if(F.col("change") == c).alias(n) for c, n in (("changed", "changed"), ("created", "added"), ("removed", "removed"))])


# ------------------------------------------------------------------------ diffs

CHANNEL_LABELS = {"slide": "页面上", "script": "演讲文稿", "drop": "已丢弃"}


def _label(c: Column, mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[c]


def _change(kind: str, before: Column, after: Column, note: Column | str = "") -> Column:
    n = F.lit(note) if isinstance(note, str) else note
    return F.struct(F.lit(kind).alias("kind"), before.cast("string").alias("before"), after.cast("string").alias("after"),
                    n.alias("note"))


def _pairs(a: DataFrame, b: DataFrame, uid: str) -> DataFrame:
    cols = [c for c in a.columns if c != uid]
    return a.select(uid, F.struct(*cols).alias("b")).join(b.select(uid, F.struct(*cols).alias("a")), uid, "full_outer")


def diff_blocks(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes a reader would notice, one row each: block_uid, kind, before, after, note."""
    j = _pairs(md.diff_fields(before, md.DIFF_BLOCK_FIELDS), md.diff_fields(after, md.DIFF_BLOCK_FIELDS), "block_uid")
    none = F.lit(None)
    there = F.col("b").isNotNull() & F.col("a").isNotNull()

    def pin(c: Column) -> Column:
        return F.when(c, "已固定").otherwise("未固定")

    def importance(c: Column) -> Column:
        return F.concat(F.lit("重要度 "), F.format_number(c / 1000, 2))

    rows = F.array_compact(F.array(
        F.when(F.col("a").isNull(), _change("structure", F.col("b.content"), none, "已移除")),
        F.when(F.col("b").isNull(), _change("structure", none, F.col("a.content"), "新增")),
        F.when(there & (F.col("a.content") != F.col("b.content")), _change("text", F.col("b.content"), F.col("a.content"))),
        F.when(there & (F.col("a.channel") != F.col("b.channel")), _change(
            "channel", _label(F.col("b.channel"), CHANNEL_LABELS), _label(F.col("a.channel"), CHANNEL_LABELS), "内容保留，位置改变")),
        F.when(there & (F.col("a.pinned") != F.col("b.pinned")), _change("style", pin(F.col("b.pinned")), pin(F.col("a.pinned")))),
        F.when(there & (F.abs(F.col("a.importance_milli") - F.col("b.importance_milli")) > 10), _change(
            "style", importance(F.col("b.importance_milli")), importance(F.col("a.importance_milli"))))))
    return j.select("block_uid", F.explode(rows).alias("c")).select("block_uid", "c.*")


def diff_slides(before: DataFrame, after: DataFrame) -> DataFrame:
    j = _pairs(md.diff_fields(before, ("deck_uid", *md.DIFF_SLIDE_FIELDS)),
               md.diff_fields(after, ("deck_uid", *md.DIFF_SLIDE_FIELDS)), "slide_uid")
    none = F.lit(None)
    there = F.col("b").isNotNull() & F.col("a").isNotNull()

    def reserve(c: Column) -> Column:
        return F.when(c, "备用页").otherwise("正式页")

    def seconds(c: Column) -> Column:
        return F.concat(F.bround(c, 0).cast("long"), F.lit("s"))

    moved = F.abs(F.col("a.dwell_seconds") - F.col("b.dwell_seconds")) >= 1.0
    rows = F.array_compact(F.array(
        F.when(F.col("a").isNull(), _change("structure", F.col("b.title"), none, "页面已移除")),
        F.when(F.col("b").isNull(), _change("structure", none, F.col("a.title"), "新增页面")),
        F.when(there & (F.col("a.title") != F.col("b.title")), _change("title", F.col("b.title"), F.col("a.title"))),
        F.when(there & (F.col("a.role") != F.col("b.role")), _change("structure", F.col("b.role"), F.col("a.role"), "版式改变")),
        F.when(there & (F.col("a.is_backup") != F.col("b.is_backup")), _change(
            "structure", reserve(F.col("b.is_backup")), reserve(F.col("a.is_backup")))),
        F.when(there & (F.col("a.dwell_seconds") > 0) & (F.col("b.dwell_seconds") > 0) & moved, _change(
            "timing", seconds(F.col("b.dwell_seconds")), seconds(F.col("a.dwell_seconds")), F.col("b.title")))))
    return j.select(F.coalesce("b.deck_uid", "a.deck_uid").alias("deck_uid"), "slide_uid", F.explode(rows).alias("c")).select(
        "deck_uid", "slide_uid", "c.*")


def diff_deck_meta(before: DataFrame, after: DataFrame) -> DataFrame:
    j = _pairs(before.select("deck_uid", "total_seconds", "density"), after.select("deck_uid", "total_seconds", "density"), "deck_uid")
    rows = F.array_compact(F.array(
        F.when(F.col("a.total_seconds") != F.col("b.total_seconds"), _change(
            "meta", F.concat("b.total_seconds", F.lit("s")), F.concat("a.total_seconds", F.lit("s")), "总时长")),
        F.when(F.col("a.density") != F.col("b.density"), _change("meta", F.col("b.density"), F.col("a.density"), "版面密度"))))
    return j.select("deck_uid", F.explode(rows).alias("c")).select("deck_uid", "c.*")


def fold_timing(changes: DataFrame, focus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes shown, notes): more than three timing changes outside the focus become a count per deck.

    ``focus``: slide_uid of slides the edit named."""
    f = focus.select("slide_uid").distinct().withColumn("__f", F.lit(True))
    c = changes.join(f, "slide_uid", "left").withColumn("__side", (F.col("kind") == "timing") & F.col("__f").isNull())
    c = scale.with_totals(c, ["deck_uid"], {"__n": F.count_if("__side")})
    shown = c.filter(~(F.col("__side") & (F.col("__n") > 3)))
    notes = c.filter(F.col("__side") & (F.col("__n") > 3)).groupBy("deck_uid").agg(F.count(F.lit(1)).alias("retimed"))
    return shown.drop("__f", "__side", "__n"), notes
