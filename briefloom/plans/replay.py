"""Applying an edit log to the tables of many decks at once.

Edits that only set columns never depend on each other's structure, so everything that happens between two structural
patches collapses to final values: one aggregation, however many edits there are. A structural patch (splitting, merging,
moving, inserting, reordering, rewriting, removing, or any patch that spans slides) depends on the earlier ones that touch
the same slide and on nothing else. Its stage is the longest chain of such patches that ends in it, so patches on different
slides of a deck share a stage, and a log has as many stages as its longest chain. A deck leaves the work after its last
stage; what is written per stage are the decks still in it, so a lost executor repeats at most one stage.

A slide stands for all that comes out of it: a page split off belongs to the slide it was split from. A block that the log
moves belongs to every slide it may be on. A patch that names something the log itself creates may touch any slide of its
deck, so it waits for all earlier patches of the deck and all later ones wait for it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefloom import scale
from briefloom.operators import edits as ed
from briefloom.operators import model as md
from briefloom.session import cut_each, cut_lineage, discard

STRUCTURAL = ("rewrite", "split_block", "merge_blocks", "insert_block", "move_block", "reorder_slides", "split_slide")
CREATING = ("split_block", "insert_block", "split_slide")
# What an edit may say beyond deck_uid, seq, op_no, patch_id, op and target; a log that lacks a column says nothing there.
ARGUMENTS = {"value": "string", "hard": "boolean", "max_units": "int", "preserve_spans": "boolean", "parts": "array<string>", "others": "array<string>",
             "separator": "string", "to_slide": "string", "index": "int", "position": "string", "order": "array<string>", "after_block": "string",
             "asset_ref": "string", "subtitle": "string", "layout_hint": "string", "total_seconds": "int", "density": "string",
             "target_dwell_seconds": "double", "font_size_pt": "double", "emphasis": "string", "new_type": "string", "new_derivation": "string"}


@dataclass(frozen=True)
class Decks:
    """``slides``: deck_uid, section_uid, slide_uid, slide_no, title, role, is_backup, dwell_seconds, dwell_locked.
    ``blocks``: deck_uid, slide_uid, block_uid, block_no, type, content, channel, channel_pinned, pinned,
    importance_milli, derivation, spans, speaker_note, word_budget. ``sections``: deck_uid, section_uid, title. ``assets``:
    deck_uid, asset_uid, caption. ``decks``: deck_uid, total_seconds, density, target_dwell_seconds. Uids are strings,
    unique over all decks. Blocks may have asset_ref and tags, slides subtitle and layout_hint; what is not there is
    added as null, and tables not given are made from the slides (no assets)."""

    slides: DataFrame
    blocks: DataFrame
    sections: DataFrame | None = None
    assets: DataFrame | None = None
    decks: DataFrame | None = None

    def whole(self) -> Decks:
        """With all tables and columns."""
        null = lambda kind: F.lit(None).cast(kind)
        add = lambda df, **cols: df.withColumns({c: null(k) for c, k in cols.items() if c not in df.columns})
        slides = add(self.slides, subtitle="string", layout_hint="string").withColumn("slide_no", F.col("slide_no").cast("double"))
        sections = slides.select("deck_uid", "section_uid").distinct() if self.sections is None else self.sections
        assets = slides.select("deck_uid", null("string").alias("asset_uid")).limit(0) if self.assets is None else self.assets
        decks = slides.select("deck_uid").distinct() if self.decks is None else self.decks
        return Decks(slides, add(self.blocks, asset_ref="string", tags="array<string>"), add(sections, title="string"), add(assets, caption="string"),
                     add(decks, total_seconds="int", density="string", target_dwell_seconds="double"))

    def tables(self) -> dict[str, DataFrame]:
        return {"slides": self.slides, "blocks": self.blocks, "sections": self.sections, "assets": self.assets, "decks": self.decks}

    def each(self, change: Callable[[DataFrame], DataFrame]) -> Decks:
        return Decks(**{k: change(t) for k, t in self.tables().items()})

    def nodes(self) -> DataFrame:
        no = F.lit(False).alias("is_visual")
        one = lambda t, uid, kind, seen=no: t.select("deck_uid", F.col(uid).alias("uid"), F.lit(kind).alias("kind"), seen)
        return (one(self.slides, "slide_uid", "slide").unionByName(one(self.sections, "section_uid", "section"))
                .unionByName(one(self.blocks, "block_uid", "block", md.is_visual().alias("is_visual")))
                .unionByName(one(self.assets, "asset_uid", "asset")).unionByName(one(self.decks, "deck_uid", "deck")))


def with_arguments(ops: DataFrame) -> DataFrame:
    return ops.withColumns({c: F.lit(None).cast(k) for c, k in ARGUMENTS.items() if c not in ops.columns})


def _structural() -> F.Column:
    return F.col("op").isin(*STRUCTURAL) | ((F.col("op") == "delete_block") & F.coalesce("hard", F.lit(False)))


# --------------------------------------------------------------------------- stages


def touched(d: Decks, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patches, touches): deck_uid, patch_id, seq, staged, wild per patch; deck_uid, patch_id, place per place it touches.

    A place is a slide, section, asset or deck as the tables have it before the log. ``wild`` patches may touch any place.
    """
    named = F.array_compact(F.concat(F.array("target", "to_slide"), *[F.coalesce(c, F.array().cast("array<string>")) for c in ("others", "order")]))
    # A split puts a page into its section.
    split = ops.filter("op = 'split_slide'").join(d.slides.select(F.col("slide_uid").alias("target"), F.col("section_uid").alias("uid")), "target")
    uids = (ops.select("deck_uid", "patch_id", F.explode(F.array_distinct(named)).alias("uid"))
            .unionByName(split.select("deck_uid", "patch_id", "uid")).distinct())
    own = d.nodes().filter("kind <> 'block'").select("deck_uid", "uid", F.col("uid").alias("place"))
    blocks = d.blocks.select("deck_uid", F.col("block_uid").alias("uid"), F.col("slide_uid").alias("place"))
    moved = ops.filter("op = 'move_block'").select("deck_uid", F.col("target").alias("uid"), F.col("to_slide").alias("place"))
    homes = own.unionByName(blocks).unionByName(moved.join(d.slides.select("deck_uid", F.col("slide_uid").alias("place")), ["deck_uid", "place"], "left_semi"))
    met = uids.join(homes.distinct(), ["deck_uid", "uid"], "left")
    made = ops.filter(F.col("op").isin(*CREATING)).select("deck_uid").distinct().withColumn("__made", F.lit(True))
    met = cut_lineage(met.join(made, "deck_uid", "left").withColumn("unknown", F.col("place").isNull() & F.coalesce("__made", F.lit(False))))
    per = met.groupBy("deck_uid", "patch_id").agg(F.countDistinct("place").alias("places"), F.bool_or("unknown").alias("wild"))
    patches = (ops.groupBy("deck_uid", "patch_id").agg(F.min("seq").alias("seq"), F.bool_or(_structural()).alias("deep"))
               .join(per, ["deck_uid", "patch_id"], "left"))
    wild = F.coalesce("wild", F.lit(False))
    staged = F.col("deep") | wild | (F.coalesce("places", F.lit(0)) > 1)
    return (cut_lineage(patches.select("deck_uid", "patch_id", "seq", staged.alias("staged"), wild.alias("wild"))),
            met.filter("place IS NOT NULL").select("deck_uid", "patch_id", "place").distinct())


def stages(patches: DataFrame, touches: DataFrame) -> DataFrame:
    """(deck_uid, patch_id, staged, wild, stage): when a patch is applied.

    A staged patch has a stage of its own from 1 on, after the stages of all earlier staged patches that touch one of
    its places; any other patch is applied after the stage it names, before the next. The longest chain is found by joins with
    the patch before on each place, until nothing changes.
    """
    keys = ["deck_uid", "patch_id"]
    epochs = cut_lineage(scale.running(patches, ["deck_uid"], scale.position_chunk("seq"), ["seq"], {"epoch": F.col("wild").cast("int")}))
    at = touches.join(epochs.filter("NOT wild"), keys)
    before = cut_lineage(scale.latest_before(at, ["deck_uid", "epoch", "place"], scale.position_chunk("seq"), ["seq"],
                                             {"before": F.when(F.col("staged"), F.col("patch_id"))}, inclusive=False))
    links = before.filter("before IS NOT NULL").select(*keys, "before", "staged").distinct()
    level = cut_lineage(epochs.filter("staged AND NOT wild").select(*keys, F.lit(1).alias("level")))
    earlier = lambda lv: lv.select("deck_uid", F.col("patch_id").alias("before"), F.col("level").alias("__b"))
    while True:
        reached = links.filter("staged").join(earlier(level), ["deck_uid", "before"]).groupBy(*keys).agg(F.max("__b").alias("__b"))
        grown = cut_lineage(level.join(reached, keys, "left").select(*keys, (F.coalesce("__b", F.lit(0)) + 1).alias("level"), F.col("level").alias("was")))
        done = grown.filter("level <> was").isEmpty()
        discard(level)
        level = grown.drop("was")
        if done:
            break
    free = links.filter("NOT staged").join(earlier(level), ["deck_uid", "before"]).groupBy(*keys).agg(F.max("__b").alias("level"))
    local = epochs.join(level.unionByName(free), keys, "left").withColumn("level", F.coalesce("level", F.lit(0)))
    deep = local.groupBy("deck_uid", "epoch").agg(F.max("level").alias("deepest"), F.max(F.col("wild").cast("int")).alias("barrier"))
    offsets = scale.running(deep, ["deck_uid"], scale.position_chunk("epoch"), ["epoch"], {"offset": F.col("deepest") + F.col("barrier")})
    stage = F.col("offset") + F.when(F.col("wild"), F.col("deepest") + 1).otherwise(F.col("level"))
    return cut_lineage(local.join(offsets, ["deck_uid", "epoch"]).select(*keys, "seq", "staged", "wild", stage.cast("int").alias("stage")))


# ----------------------------------------------------------------------- application


def _set_columns(d: Decks, ops: DataFrame, kinds: set[str]) -> Decks:
    """Final values of column edits of the given kinds, already found valid. Tables that no kind writes stay as they are."""
    last = ed.latest_values(ops.filter("op NOT IN ('set_text', 'set_style', 'replace_asset')"))
    slides, blocks, sections, assets, decks = d.slides, d.blocks, d.sections, d.assets, d.decks

    def of(kind: str) -> DataFrame:
        return ops.filter(F.col("op") == kind)

    def by_hand(t: DataFrame, kind: str, key: str, column: str) -> DataFrame:
        hit = of(kind).select(F.col("target").alias(key), F.lit(True).alias("__h")).distinct()
        return t.join(hit, key, "left").withColumn(column, F.coalesce("__h", column)).drop("__h")

    if kinds & {"set_text", "set_caption"}:
        on_assets = d.assets.select(F.col("asset_uid").alias("target"))
        blocks = ed.set_text(blocks, of("set_text").unionByName(of("set_caption").join(on_assets, "target", "left_anti")))
    for column, cast, field, writers in (("channel", "string", "channel", {"set_channel", "delete_block"}), ("importance_milli", "int", "importance", {"set_importance"}),
                                         ("pinned", "boolean", "pinned", {"pin"})):
        if kinds & writers:
            blocks = ed.set_column(blocks, last, field, column, cast)
    if "set_channel" in kinds:
        blocks = by_hand(blocks, "set_channel", "block_uid", "channel_pinned")
    if "set_style" in kinds:
        blocks = ed.set_style(blocks.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))), of("set_style"))
    if "replace_asset" in kinds:
        blocks, _ = ed.replace_assets(blocks, of("replace_asset"), d.assets)
    for column, cast, kind in (("title", "string", "set_title"), ("role", "string", "set_slide_role"), ("is_backup", "boolean", "set_backup"),
                               ("dwell_seconds", "double", "set_dwell")):
        if kind in kinds:
            slides = ed.set_column(slides, last, column, column, cast, key="slide_uid")
    for kind, argument in (("set_title", "subtitle"), ("set_slide_role", "layout_hint")):
        if kind in kinds:
            said = ed.latest_arguments(of(kind), [argument]).withColumnsRenamed({"target": "slide_uid", argument: "__v"})
            slides = slides.join(said, "slide_uid", "left").withColumn(argument, F.coalesce("__v", argument)).drop("__v")
    if "set_dwell" in kinds:
        slides = by_hand(slides, "set_dwell", "slide_uid", "dwell_locked")
    if "set_title" in kinds:
        sections = ed.set_column(sections, last, "title", "title", "string", key="section_uid")
    if "set_caption" in kinds:
        assets = ed.set_column(assets, last, "caption", "caption", "string", key="asset_uid")
    if "retime" in kinds:
        timing = ("total_seconds", "density", "target_dwell_seconds")
        said = ed.latest_arguments(of("retime"), timing).withColumnsRenamed({"target": "deck_uid", **{c: f"__{c}" for c in timing}})
        decks = decks.join(said, "deck_uid", "left").withColumns({c: F.coalesce(f"__{c}", c) for c in timing})
    same = lambda new, old: old if new is old else new.select(*old.columns)
    return Decks(same(slides, d.slides), same(blocks, d.blocks), same(sections, d.sections), same(assets, d.assets), same(decks, d.decks))


BLOCK_KINDS = ("rewrite", "split_block", "merge_blocks", "delete_block", "insert_block", "move_block", "split_slide")  # in the order they apply


def _slides_named(d: Decks, ops: DataFrame) -> DataFrame:
    """(op, slide_uid): the slides, as they are now, that an edit of each kind names or whose blocks it names."""
    named = F.array_compact(F.concat(F.array("target", "to_slide"), F.coalesce("others", F.array().cast("array<string>"))))
    uids = ops.filter(F.col("op").isin(*BLOCK_KINDS)).select("op", F.explode(named).alias("uid")).distinct()
    homes = d.blocks.select(F.col("block_uid").alias("uid"), "slide_uid").unionByName(d.slides.select(F.col("slide_uid").alias("uid"), "slide_uid"))
    return uids.join(homes, "uid").filter("slide_uid IS NOT NULL").select("op", "slide_uid").distinct()


def _edit_blocks(slides: DataFrame, blocks: DataFrame, ops: DataFrame, kind: str, step: int, whole: bool) -> tuple[DataFrame, DataFrame | None, list[DataFrame]]:
    """(blocks, slides where they changed, refused) after the edits of one kind."""
    columns = blocks.columns
    if kind == "rewrite":
        keep = F.coalesce("preserve_spans", F.lit(True)).alias("preserve_spans")
        return ed.rewrite(blocks, ops.select("target", "max_units", keep)).select(*columns), None, []
    if kind == "split_block":
        new, bad = ed.split_blocks(blocks, ops.select("target", "parts"), whole)
        return new.select(*columns), None, [bad]
    if kind == "merge_blocks":
        new, bad = ed.merge_blocks(blocks, ops.select(F.col("patch_id").alias("op_id"), "target", "others", "separator"), whole=whole)
        return new.select(*columns), None, [bad]
    if kind == "delete_block":
        return ed.delete_blocks(blocks, ops.select("target", "hard"), whole).select(*columns), None, []
    if kind == "insert_block":
        rows = ops.select(
            "deck_uid", F.col("seq").alias("op_id"), "target", F.coalesce("position", F.lit("after")).alias("position"), F.col("value").alias("content"),
            F.coalesce("new_type", F.lit("bullet")).alias("type"), F.coalesce("new_derivation", F.lit("authored")).alias("derivation"),
            F.lit("slide").alias("channel"), F.lit(False).alias("channel_pinned"),
            F.lit(False).alias("pinned"), F.lit(500).alias("importance_milli"), F.array().cast(blocks.schema["spans"].dataType).alias("spans"))
        new, bad = ed.insert_blocks(blocks, rows, whole)
        return new.select(*columns), None, [bad]
    if kind == "move_block":
        here = slides.select(F.col("slide_uid").alias("to_slide"))
        new = ed.move_blocks(blocks, ops.join(here, "to_slide", "left_semi").select("target", "to_slide", "index"), whole)
        return new.select(*columns), None, [ops.join(here, "to_slide", "left_anti")]
    more, new, bad = ed.split_slides(slides, blocks, ops.select("target", "after_block"))
    # The time stays with the first page. A later split of the same page in this patch puts its page before the earlier one's.
    old = slides.select("slide_uid", F.lit(True).alias("__old"))
    more = more.join(old, "slide_uid", "left").withColumns({
        "slide_no": F.col("slide_no") + F.when(F.col("__old"), 0.0).otherwise(0.5 ** step - 0.5),
        "dwell_seconds": F.when(F.col("__old"), F.col("dwell_seconds")),
        "dwell_locked": F.when(F.col("__old"), F.col("dwell_locked")).otherwise(False)})
    return new.select(*columns), more, [bad]


def _structural_step(d: Decks, ops: DataFrame, kinds: set[str], step: int) -> tuple[Decks, DataFrame]:
    """One edit per patch; returns the new tables, those that changed written out, and the targets that were refused.

    ``ops`` and the tables are written. Patches of one stage are on different slides, so the kinds of edits do not meet: each
    works on the slides that its edits name, all at once, and every block is written once, however many kinds there are.
    """
    slides, blocks, refused = d.slides, d.blocks, []
    of = lambda kind: ops.filter(F.col("op") == kind)
    mine = [k for k in BLOCK_KINDS if k in kinds]

    def pages(df: DataFrame) -> DataFrame:
        return df.withColumn("slide_no", F.col("slide_no").cast("double")).select(*d.slides.columns)

    if "reorder_slides" in kinds:
        new, bad = ed.reorder_slides(slides, of("reorder_slides").select("target", "order"))
        refused.append(bad)
        slides = cut_lineage(pages(new))
    if mine:
        at = cut_each({"large": scale.large_groups(blocks, ["slide_uid"]), "named": _slides_named(replace(d, slides=slides), ops)})
        whole, named = at["large"].isEmpty(), at["named"]
        apart = named.groupBy("slide_uid").agg(F.countDistinct("op").alias("n")).filter("n > 1").isEmpty()
        if apart:
            parts, numbering = {}, [k for k in mine if k not in ("rewrite", "split_slide")]  # these number all blocks at work
            for kind in mine:
                here = blocks.join(named.filter(F.col("op") == kind).select("slide_uid"), "slide_uid", "left_semi")
                if numbering and kind != numbering[0]:
                    here = ed.renumber_blocks(here, whole).select(*blocks.columns)
                parts[kind], more, bad = _edit_blocks(slides, here, of(kind), kind, step, whole)
                refused += bad
                if more is not None:
                    parts["slides"] = pages(more)
            rest = blocks.join(named.select("slide_uid").distinct(), "slide_uid", "left_anti")
            if numbering:
                rest = ed.renumber_blocks(rest, whole).select(*blocks.columns)
            if len(mine) == 1:
                parts[mine[0]] = parts[mine[0]].unionByName(rest)
            else:
                parts["rest"] = rest
            done = cut_each(parts)
            slides, blocks = done.pop("slides", slides), None
            for part in done.values():
                blocks = part if blocks is None else blocks.unionByName(part)
        else:  # edits of several kinds on one slide: one kind after the other
            for kind in mine:
                new, more, bad = _edit_blocks(slides, blocks, of(kind), kind, step, whole)
                refused += bad
                done = cut_each({"blocks": new} if more is None else {"blocks": new, "slides": pages(more)})
                slides, blocks = done.get("slides", slides), done["blocks"]
    out = ops.select(F.col("target").cast("string").alias("target")).limit(0)
    for bad in refused:
        out = out.unionByName(bad.select(F.col("target").cast("string").alias("target")))
    return replace(d, slides=slides, blocks=blocks), out


def _renumbered(slides: DataFrame) -> DataFrame:
    """Pages numbered from 1 in their section, in the order they have."""
    at = slides.withColumnRenamed("slide_no", "__at")
    placed = scale.running(at, ["deck_uid", "section_uid"], {"__chunk": F.floor(F.col("__at") / scale.CHUNK)}, ["__at", "slide_uid"], number="slide_no")
    return placed.withColumn("slide_no", F.col("slide_no").cast("double")).select(*slides.columns)


def _refused_references(ops: DataFrame, d: Decks) -> DataFrame:
    """Edits that name an asset the deck does not have."""
    return ops.filter("op = 'replace_asset'").join(d.assets.select("deck_uid", F.col("asset_uid").alias("asset_ref")), ["deck_uid", "asset_ref"], "left_anti")


def _judged(edits: DataFrame, d: Decks) -> tuple[DataFrame, DataFrame]:
    """``reject_invalid``, written: every kind of edit reads what is valid."""
    fine, bad = ed.reject_invalid(edits, d.nodes())
    both = cut_each({"fine": fine, "bad": bad})
    return both["fine"], both["bad"]


def _cut(new: Decks, old: Decks) -> Decks:
    """``new`` with the lineage of what changed cut."""
    return replace(new, **cut_each({k: t for k, t in new.tables().items() if t is not old.tables()[k]}))


def _restore(old: Decks, new: Decks, places: DataFrame, everywhere: DataFrame) -> Decks:
    """``new``, but what belongs to the given places, or decks, as it was in ``old``."""
    def marked(d: Decks) -> dict[str, DataFrame]:
        of = d.slides.select("slide_uid", F.col("family").alias("__place"))
        return {"slides": d.slides.withColumn("__place", F.col("family")), "blocks": d.blocks.join(of, "slide_uid", "left"),
                "sections": d.sections.withColumn("__place", F.col("section_uid")), "assets": d.assets.withColumn("__place", F.col("asset_uid")),
                "decks": d.decks.withColumn("__place", F.col("deck_uid"))}

    back = cut_lineage(places.select("deck_uid", F.col("place").alias("__place")).unionByName(
        everywhere.select("deck_uid", F.lit(None).cast("string").alias("__place"))).distinct())
    some, whole = back.filter("__place IS NOT NULL"), back.filter("__place IS NULL").select("deck_uid")
    out, befores = {}, marked(old)
    for name, after in marked(new).items():
        if new.tables()[name] is old.tables()[name]:
            continue
        before = befores[name]
        gone = lambda t: t.join(some, ["deck_uid", "__place"], "left_anti").join(whole, "deck_uid", "left_anti")
        kept = lambda t: t.join(some, ["deck_uid", "__place"], "left_semi").unionByName(t.join(whole, "deck_uid", "left_semi")).dropDuplicates([
            c for c in ("slide_uid", "block_uid", "section_uid", "asset_uid") if c in t.columns] or ["deck_uid"])
        out[name] = gone(after).unionByName(kept(before)).drop("__place").select(*new.tables()[name].columns)
    return replace(new, **cut_each(out))


def apply_patches(d: Decks, ops: DataFrame, reallocate: Callable[[Decks, DataFrame], Decks] | None = None) -> tuple[Decks, DataFrame]:
    """(tables after the log, refused patches: deck_uid, patch_id). Each patch applies whole or not at all.

    ``ops``: deck_uid, seq, op_no (from 1), patch_id, op, target and the columns of ``ARGUMENTS`` that the log uses. Edits of decks
    that are not in the tables are refused. ``reallocate`` gets the tables after the log and the decks whose budget an accepted edit
    put out of date, once for the whole log.
    """
    d = d.whole()
    d = replace(d, slides=d.slides.withColumn("family", F.col("slide_uid")))
    ops = cut_lineage(with_arguments(ops))
    patches, touches = touched(d, ops)
    plan = stages(patches, touches)
    log = cut_lineage(ops.join(plan.drop("seq"), ["deck_uid", "patch_id"]))
    # Which kinds of edit each round holds: one short row per round of the driver loop, whatever the log's size.
    found = log.groupBy("stage", "staged", F.when(F.col("staged"), F.col("op_no")).alias("op_no")).agg(F.collect_set("op").alias("ops")).collect()
    rounds = {(r.stage, r.op_no): set(r.ops) for r in found if r.staged}
    free = {r.stage: set(r.ops) for r in found if not r.staged}
    steps = max((no for _, no in rounds), default=0)
    final = cut_lineage(plan.groupBy("deck_uid").agg(F.max("stage").alias("final")))
    last = max([*free, *(s for s, _ in rounds)], default=-1)
    only = lambda rule: final.filter(rule).select("deck_uid")
    # Decks without an edit from here on leave the work: those the log does not name now, the others after their last stage.
    finished = [d.each(lambda t: t.join(only(F.lit(True)), "deck_uid", "left_anti"))]
    full, refused = d, None
    for stage in range(last + 1):
        here, over = only(F.col("final") >= stage), only(F.col("final") == stage - 1)
        if stage:
            finished.append(full.each(lambda t, over=over: t.join(over, "deck_uid", "left_semi")))
        d = entered = full.each(lambda t, here=here: t.join(here, "deck_uid", "left_semi"))
        now = log.filter(F.col("stage") == stage)
        lost = ops.select("deck_uid", "patch_id").limit(0)
        if any("split_slide" in kinds for (s, _), kinds in rounds.items() if s == stage):
            d = replace(d, slides=cut_lineage(_renumbered(d.slides)))  # whole numbers, so that new pages find room
        before, whole = d, now.filter("staged")
        for step in range(1, steps + 1):
            kinds = rounds.get((stage, step), set())
            if not kinds:
                continue
            edits, start = whole.filter(F.col("op_no") == step), d
            fine, bad = _judged(edits, d)
            bad = bad.select("deck_uid", "patch_id").unionByName(_refused_references(fine, d).select("deck_uid", "patch_id"))
            if kinds - set(STRUCTURAL):
                d = _set_columns(d, fine.filter(~_structural()), kinds)
            loose = d
            d, no = _structural_step(d, fine.filter(_structural()), kinds, step)
            turned = edits.join(no, "target", "left_semi").select("deck_uid", "patch_id")
            lost = cut_lineage(lost.unionByName(bad).unionByName(turned).distinct())
            # What the structural edits changed is written already.
            d = _cut(d, replace(start, **{k: t for k, t in d.tables().items() if t is not loose.tables()[k]}))
        if d is not before and not lost.isEmpty():
            # What a failed patch touched returns to where it stood before it.
            places = touches.join(lost, ["deck_uid", "patch_id"], "left_semi")
            d = _restore(before, d, places, plan.filter("wild").join(lost, ["deck_uid", "patch_id"], "left_semi").select("deck_uid"))
        if stage in free:
            loose = now.filter("NOT staged")
            valid, bad = _judged(loose, d)
            missing = _refused_references(valid, d).select("deck_uid", "patch_id").distinct()
            lost = lost.unionByName(bad.select("deck_uid", "patch_id")).unionByName(missing).distinct()
            if "replace_asset" in free[stage]:
                valid = cut_lineage(valid.join(missing, ["deck_uid", "patch_id"], "left_anti"))
            d = _cut(_set_columns(d, valid, free[stage]), d)
        refused = lost if refused is None else refused.unionByName(lost)
        full = Decks(**{k: full.tables()[k] if t is entered.tables()[k] else t for k, t in d.tables().items()})
    out = full.each(lambda t: t.join(only(F.col("final") >= last), "deck_uid", "left_semi"))
    for part in finished:
        out = Decks(**{k: t.unionByName(part.tables()[k]) for k, t in out.tables().items()})
    out = replace(out, slides=out.slides.drop("family"))
    refused = ops.select("deck_uid", "patch_id").limit(0) if refused is None else cut_lineage(refused)
    if reallocate is not None:
        good = ops.join(refused, ["deck_uid", "patch_id"], "left_anti")
        out = reallocate(out, ed.needs_reallocation(good).filter("reallocate").select("deck_uid"))
    return out, refused


def replay(original: Decks, log: DataFrame, decks: DataFrame) -> tuple[Decks, DataFrame, DataFrame]:
    """The log folded over the original tables; rows of decks that are not here are set aside as foreign."""
    mine = log.join(decks.select("deck_uid"), "deck_uid", "left_semi")
    foreign = log.join(decks.select("deck_uid"), "deck_uid", "left_anti")
    after, refused = apply_patches(original, mine)
    return after, refused, foreign


def changes(before: Decks, after: Decks) -> DataFrame:
    """All that a reader would notice between two states: node (deck, slide or block), uid, kind, before, after, note."""
    said = lambda t, node, uid: t.select(F.lit(node).alias("node"), F.col(uid).alias("uid"), "kind", "before", "after", "note")
    return (said(ed.diff_deck_meta(before.decks, after.decks), "deck", "deck_uid").unionByName(said(ed.diff_slides(before.slides, after.slides), "slide", "slide_uid"))
            .unionByName(said(ed.diff_blocks(before.blocks, after.blocks), "block", "block_uid")))


def preview(d: Decks, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes the edits would make to decks, slides and blocks, patches that cannot be applied); nothing is kept."""
    after, refused = apply_patches(d, ops)
    return changes(d.whole(), after), refused


def state_at(original: Decks, log: DataFrame, cuts: DataFrame) -> Decks:
    """The tables as of a position of each deck's log: its edits up to ``cuts`` (deck_uid, seq); decks without a cut at the end."""
    upto = log.join(cuts.select("deck_uid", F.col("seq").alias("__cut")), "deck_uid", "left").filter(F.col("__cut").isNull() | (F.col("seq") <= F.col("__cut")))
    return apply_patches(original, upto.drop("__cut"))[0]


def total_diff(original: Decks, log: DataFrame, start: DataFrame, end: DataFrame) -> DataFrame:
    """All changes between two positions of each deck's log (``start``, ``end``: deck_uid, seq). The log up to the start is applied
    once, what lies between is applied to that state."""
    first = state_at(original, log, start)
    span = log.join(start.select("deck_uid", F.col("seq").alias("__cut")), "deck_uid").filter(F.col("seq") > F.col("__cut")).drop("__cut")
    return changes(first.whole(), state_at(first, span, end))
