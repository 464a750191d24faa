"""Documents to planned decks in one call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.functions import claims as cl
from briefloom.operators import budget as bg
from briefloom.operators import model as md
from briefloom.operators import planning as pl
from briefloom.session import cut_lineage


@dataclass(frozen=True)
class Planned:
    decks: DataFrame
    sections: DataFrame
    slides: DataFrame
    blocks: DataFrame
    navigation: DataFrame
    agenda: DataFrame


def paged_documents(docs: DataFrame, density: str = "balanced", unit_limit: int | None = None,
                    claims=cl.CLAIM_WORDS, elaborations=cl.ELABORATION_WORDS,
                    rubrics=cl.RUBRIC_WORDS) -> DataFrame:
    """All in-row steps: groups, front matter, blocks, packed and merged pages."""
    d = pl.front_matter(pl.heading_groups(docs))

    def block(s: Column, g: Column) -> Column:
        return pl.segment_block(s, cl.classify_by_keywords(g["title"], rubrics), unit_limit, claims, elaborations)

    d = d.withColumn("blocks", F.zip_with("segs", "groups", block))
    d = pl.pack_pages(d, density)
    return pl.coalesce_pages(pl.page_totals(d), density)


def page_blocks(paged: DataFrame) -> DataFrame:
    """One row per block with its group, final page and page title; front matter and empty pages are gone."""
    places = F.map_from_entries(F.transform("final", lambda f: F.struct(f["page"], f["no"])))
    titles = F.map_from_entries(F.transform("page_list", lambda p: F.struct(p["page"], p["title"])))
    rows = F.zip_with(F.zip_with("segs", "blocks", lambda s, b: F.struct(s.alias("s"), b.alias("b"))), "pages",
                      lambda x, p: F.struct(x["s"].alias("s"), x["b"].alias("b"), p.alias("p")))
    keep = F.filter(rows, lambda r: r["p"]["on"] & r["b"].isNotNull())
    flat = paged.select("doc_id", "has_front", F.explode(keep).alias("r"), places.alias("__places"),
                        titles.alias("__titles"))
    return flat.filter(~(F.col("has_front") & (F.col("r.p.grp") == 1))).select(
        "doc_id", F.col("r.p.grp").alias("section_no"), F.col("r.p.page").alias("packed"),
        F.col("__places")[F.col("r.p.page")].alias("page"), F.col("__titles")[F.col("r.p.page")].alias("title"),
        F.col("r.s.seg_no").alias("seg_no"), F.col("r.s.asset_id").alias("asset_id"), F.col("r.b.*"))


def plan_documents(docs: DataFrame, total_seconds: int, density: str = "balanced", scenario: str = "grant_defense",
                   unit_limit: int | None = None, claims=cl.CLAIM_WORDS, elaborations=cl.ELABORATION_WORDS,
                   rubrics=cl.RUBRIC_WORDS) -> Planned:
    """Decks, ordered sections, pages with roles, sourced blocks and navigation for every document.

    Blocks leave their document once, and are written: pages, sections and merged blocks all read them, and none cuts and
    scores the text again.
    """
    paged = paged_documents(docs, density, unit_limit, claims, elaborations, rubrics)
    raw = cut_lineage(page_blocks(paged).select("doc_id", "section_no", "page", "title", "seg_no", "asset_id", "type", "content", "importance_milli", "channel"))
    blocks = pl.merge_asset_blocks(raw, ("doc_id", "section_no", "page"))
    text = (F.col("type") == "bullet") & (F.col("channel") == "slide")
    slides = raw.groupBy("doc_id", "section_no", "page").agg(
        F.min_by("title", "seg_no").alias("title"),
        pl.infer_role(F.bool_or(F.col("type") == "table"), F.bool_or(F.col("type") == "figure"),
                      F.bool_or(F.col("type") == "equation"), F.bool_or(text)).alias("role"),
        F.count(F.lit(1)).alias("segments"))
    heads = F.filter(F.zip_with("groups", "segs", lambda g, s: F.struct(
        g["no"].alias("no"), g["title"].alias("title"), g["opens"].alias("opens"), s["seg_no"].alias("seg"))),
        lambda g: g["opens"])
    titles = paged.select("doc_id", F.explode(heads).alias("h")).select(
        "doc_id", F.col("h.no").alias("section_no"), F.col("h.title").alias("heading"),
        F.col("h.seg").alias("heading_seg"))
    per = slides.groupBy("doc_id", "section_no").agg(F.count(F.lit(1)).alias("pages"))
    named = (per.join(titles, ["doc_id", "section_no"], "left").join(paged.select(
        "doc_id", F.col("title").alias("doc_title")), "doc_id"))
    named = named.withColumn("title", F.coalesce(F.nullif("heading", F.lit("")), "doc_title", F.lit("概述")))
    sections = bg.section_weights(named.withColumn("rubric_key", cl.classify_by_keywords(F.coalesce(
        "heading", F.lit("")), rubrics)))
    sections = sections.withColumn("live_pages", F.when(F.col("is_backup"), 0).otherwise(F.col("pages")))
    # Cover, agenda, dividers and agenda items all read the sections: a short row each, written once rather than planned again.
    sections = cut_lineage(pl.divider_numbers(pl.order_sections(sections, scenario), scenario))
    decks = md.deck_defaults(docs.select("doc_id", F.lit("en").alias("lang"), "title", "authors")).withColumns(
        {"total_seconds": F.lit(total_seconds), "density": F.lit(density), "scenario": F.lit(scenario)})
    nav = pl.navigation_pages(paged.select("doc_id", "title", "authors", "affiliation"), sections)
    return Planned(decks, sections, slides, blocks, nav, pl.agenda_items(sections))
