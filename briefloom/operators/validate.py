"""Findings about decks, one row each: deck_uid, severity, code, uid, message."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.operators import budget as bg
from briefloom.operators import model as md
from briefloom.sources.corpus import DeckTables

FACTUAL = ("bullet", "quote", "equation", "table", "figure")
# Sections a panel expects, by scenario.
REQUIRED = {
    "grant_defense": ("motivation", "objectives", "methods", "innovation", "prior_work", "feasibility", "schedule",
                      "budget", "risks"),
    "thesis_defense": ("motivation", "related_work", "methods", "results", "contributions", "limitations",
                       "future_work"),
    "conference_oral": ("motivation", "methods", "results", "contributions"),
}
SILENT_ROLES = ("section", "cover", "acknowledgement")
SPILL_RATIO = 6  # fifths: the allocation may exceed the clock by a fifth


def _found(df: DataFrame, severity: str | Column, code: str, uid: str, message: Column,
           deck: str | None = "deck_uid") -> DataFrame:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    deck_col = F.col(deck).cast("string") if deck else F.lit(None).cast("string")
    return df.select(deck_col.alias("deck_uid"), sev.alias("severity"), F.lit(code).alias("code"),
                     F.col(uid).cast("string").alias("uid"), message.alias("message"))


def _say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _in_deck(t: DeckTables, blocks: DataFrame) -> DataFrame:
    """Findings are located after the filter, so only offending rows meet the slide table."""
    return blocks.join(t.slides.select("slide_uid", "deck_uid"), "slide_uid")


def duplicate_uids(nodes: DataFrame) -> DataFrame:
    twice = md.repeated(nodes, ["deck_uid", "uid"])
    return _found(twice, "error", "DUPLICATE_UID", "uid", _say("uid appears ", F.col("n"), " times"))


def dangling_assets(t: DeckTables) -> DataFrame:
    bad = (t.blocks.filter(F.col("asset_ref").isNotNull()).select("slide_uid", "block_uid", "asset_ref")
           .join(t.assets.select(F.col("asset_uid").alias("asset_ref")), "asset_ref", "left_anti"))
    return _found(_in_deck(t, bad), "error", "DANGLING_ASSET_REF", "block_uid",
                  _say("references unknown asset ", F.col("asset_ref")))


def block_spans(blocks: DataFrame) -> DataFrame:
    return blocks.select("slide_uid", "block_uid", F.posexplode("spans").alias("span_no", "s")).select(
        "slide_uid", "block_uid", "span_no", "s.doc_id", "s.start", "s.end")


def span_findings(t: DeckTables) -> DataFrame:
    """Spans that cite an unregistered document or end past it. Both come from one join."""
    joined = block_spans(t.blocks).join(t.sources, "doc_id", "left")
    unknown = F.col("char_count").isNull()
    bad = joined.filter(unknown | ((F.col("char_count") > 0) & (F.col("end") > F.col("char_count"))))
    code = F.when(unknown, "UNKNOWN_SOURCE_DOC").otherwise("SPAN_OUT_OF_RANGE")
    message = F.when(unknown, _say("span cites unregistered document ", F.col("doc_id"))).otherwise(
        _say("span [", F.col("start"), ",", F.col("end"), ") exceeds document length ", F.col("char_count")))
    located = _in_deck(t, bad)
    return located.select(F.col("deck_uid").cast("string").alias("deck_uid"), F.lit("error").alias("severity"),
                          code.alias("code"), F.col("block_uid").alias("uid"), message.alias("message"))


def row_findings(blocks: DataFrame, strict: bool = True) -> DataFrame:
    """Provenance findings decided by one block alone (also used on streams)."""
    n = F.size("spans")
    owned = F.col("derivation") == "authored"
    unsourced = F.col("type").isin(*FACTUAL) & (n == 0) & (F.col("channel") != "drop")
    level = F.when(F.lit(strict) & (F.col("channel") == "slide"), "error").otherwise("warning")

    def one(cond: Column, severity: Column, code: str, message: str) -> Column:
        return F.when(~owned & cond, F.struct(severity.alias("severity"), F.lit(code).alias("code"),
                                              F.lit(message).alias("message")))

    found = F.array_compact(F.array(
        one(unsourced, level, "UNSOURCED_CLAIM", "carries no source span"),
        one((F.col("derivation") == "verbatim") & (n > 1) & F.col("asset_ref").isNull(), F.lit("warning"),
            "VERBATIM_MULTISPAN", "verbatim content cites several spans"),
        one((F.col("derivation") == "synthesized") & (n < 2), F.lit("info"), "SYNTHESIZED_SINGLE_SPAN",
            "synthesized content cites a single span"),
        one((F.col("derivation") == "inferred") & ~F.col("needs_confirmation"), F.lit("warning"),
            "INFERRED_NOT_FLAGGED", "inferred content must be flagged")))
    keep = [c for c in ("deck_uid", "slide_uid", "block_uid") if c in blocks.columns]
    return blocks.select(*keep, F.explode(found).alias("f")).select(*keep, "f.severity", "f.code", "f.message")


def provenance_findings(t: DeckTables, strict: bool = True) -> DataFrame:
    found = _in_deck(t, row_findings(t.blocks, strict))
    return found.select(F.col("deck_uid").cast("string").alias("deck_uid"), "severity", "code",
                        F.col("block_uid").alias("uid"), "message")


def asset_findings(t: DeckTables) -> DataFrame:
    used = t.blocks.select(F.col("asset_ref").alias("asset_uid")).filter("asset_uid IS NOT NULL")
    orphan = t.assets.join(used, "asset_uid", "left_anti")
    generated = t.assets.filter(F.col("origin") == "generated")
    unsourced = t.assets.filter(F.col("origin").isin("extracted", "redrawn") & ~F.col("has_spans"))
    return (_found(generated, "warning", "GENERATED_ASSET", "asset_uid", F.lit("generated imagery"), None)
            .unionByName(_found(unsourced, "warning", "ASSET_WITHOUT_PROVENANCE", "asset_uid",
                                _say(F.col("origin"), " asset has no span"), None))
            .unionByName(_found(orphan, "info", "ORPHAN_ASSET", "asset_uid", F.lit("asset is not used"), None)))


def dwell_totals(slides: DataFrame) -> DataFrame:
    return slides.filter(~F.col("is_backup")).groupBy("deck_uid").agg(
        F.count_if(F.col("dwell_seconds").isNull()).alias("unset"),
        F.round(F.sum("dwell_seconds"), 3).alias("dwell_total"),
        F.count_if(~md.is_navigation()).alias("content_slides"))


def dwell_findings(decks: DataFrame, slides: DataFrame) -> DataFrame:
    totals = dwell_totals(slides).join(bg.deck_budget(decks), "deck_uid")
    unset = totals.filter("unset > 0")
    limit = F.col("effective_milli") / 1000
    drift = F.col("dwell_total") - limit
    off = totals.filter((F.col("unset") == 0) & (F.col("content_slides") > 0)
                        & (F.abs(drift) > F.greatest(F.lit(30.0), limit * 0.15)))
    return (_found(unset, "info", "DWELL_UNSET", "deck_uid", _say(F.col("unset"), " slide(s) have no dwell"))
            .unionByName(_found(off, "warning", "DWELL_MISMATCH", "deck_uid",
                                _say("dwell times sum to ", F.round("dwell_total").cast("long"), "s"))))


def spoken_budget(t: DeckTables) -> DataFrame:
    """Sum of block budgets on page and script, per deck: summed per slide before the deck is known."""
    per_slide = (t.blocks.filter(F.col("channel").isin("slide", "script")).groupBy("slide_uid")
                 .agg(F.sum("word_budget").alias("spoken")))
    return (per_slide.join(t.slides.select("slide_uid", "deck_uid"), "slide_uid")
            .groupBy("deck_uid").agg(F.sum("spoken").alias("spoken")))


def over_budget(t: DeckTables) -> DataFrame:
    bad = (spoken_budget(t).join(bg.deck_budget(t.decks), "deck_uid")
           .filter((F.col("spoken") > 0) & (F.col("spoken") * 5 > F.col("total_units") * SPILL_RATIO)))
    return _found(bad, "warning", "OVER_BUDGET", "deck_uid",
                  _say("allocated ", F.col("spoken"), " units against ", F.col("total_units")))


def structure_findings(t: DeckTables) -> DataFrame:
    """Empty decks and sections, blank slides, roles their content does not support."""
    empty_deck = t.decks.join(t.sections.select("deck_uid"), "deck_uid", "left_anti")
    empty_section = t.sections.join(t.slides.select("section_uid"), "section_uid", "left_anti")
    shown = t.blocks.filter(F.col("channel") == "slide").groupBy("slide_uid").agg(
        F.bool_or(md.is_visual()).alias("has_visual"), F.bool_or(F.col("type") == "table").alias("has_table"))
    s = t.slides.join(shown, "slide_uid", "left")
    blank = s.filter(F.col("has_visual").isNull() & ~F.col("role").isin(*SILENT_ROLES))
    no_visual = s.filter(F.col("role").isin("big_figure", "text_figure") & ~F.coalesce("has_visual", F.lit(False)))
    no_table = s.filter((F.col("role") == "table") & ~F.coalesce("has_table", F.lit(False)))
    mismatch = no_visual.unionByName(no_table)
    return (_found(empty_deck, "error", "EMPTY_DECK", "deck_uid", F.lit("deck contains no sections"))
            .unionByName(_found(empty_section, "warning", "EMPTY_SECTION", "section_uid",
                                F.lit("section has no slides")))
            .unionByName(_found(blank, "warning", "BLANK_SLIDE", "slide_uid",
                                _say(F.col("role"), " slide has no slide-channel content")))
            .unionByName(_found(mismatch, "warning", "ROLE_CONTENT_MISMATCH", "slide_uid",
                                _say(F.col("role"), " slide lacks its content"))))


def rubric_gaps(decks: DataFrame, sections: DataFrame) -> DataFrame:
    """Required keys of the deck's scenario that no section has."""
    lists = F.create_map(*[x for k, v in REQUIRED.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])
    wanted = decks.select("deck_uid", F.explode(lists[F.col("scenario")]).alias("rubric_key"))
    missing = wanted.join(sections.select("deck_uid", "rubric_key"), ["deck_uid", "rubric_key"], "left_anti")
    return _found(missing, "warning", "RUBRIC_GAP", "rubric_key", _say("no section addresses ", F.col("rubric_key")))


def findings(t: DeckTables, nodes: DataFrame, strict: bool = True) -> DataFrame:
    """Every finding of every rule."""
    parts = [duplicate_uids(nodes), dangling_assets(t), span_findings(t), provenance_findings(t, strict),
             asset_findings(t), dwell_findings(t.decks, t.slides), over_budget(t), structure_findings(t),
             rubric_gaps(t.decks, t.sections)]
    return reduce(DataFrame.unionByName, parts)


def finding_summary(found: DataFrame) -> DataFrame:
    """Counts by severity per deck; a deck is ok when it has no error."""
    return found.groupBy("deck_uid").agg(
        *[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in ("error", "warning", "info")],
        (F.count_if(F.col("severity") == "error") == 0).alias("ok"))
