"""Document structure from line, paragraph and token tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom import scale
from briefloom.functions import latex as lx
from briefloom.functions import lines as ln
from briefloom.functions import text as tx
from briefloom.session import cut_lineage

def body_size(lines: DataFrame) -> DataFrame:
    """The most frequent font size per document, rounded to a tenth; the first seen wins a tie."""
    sizes = lines.filter(tx.strip("text") != "").groupBy("doc_id", F.bround("size", 1).alias("size")).agg(
        F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first"))
    return sizes.groupBy("doc_id").agg(F.max_by("size", F.struct("n", -F.col("first"))).alias("body"))


def residual_spacing(lines: DataFrame) -> DataFrame:
    """Lines per document that still look exploded."""
    return lines.groupBy("doc_id").agg(F.count_if(ln.is_exploded("text")).alias("residual"))


def line_kinds(lines: DataFrame) -> DataFrame:
    """Lines with heading_level relative to their document's body size."""
    return (lines.join(body_size(lines), "doc_id").withColumn(
        "heading_level", ln.heading_level(F.col("text"), F.col("size"), F.col("bold"), F.col("body"))))


def lines_to_paragraphs(lines: DataFrame) -> DataFrame:
    """Number the paragraph of every line (needs heading_level). Pages are the chunks, so no document is gathered."""
    chunk = {"__chunk": F.col("page")}
    head = F.col("heading_level") > 0
    starts = ln.is_list_item("text") | F.col("text").rlike(ln.CAPTION)
    before = scale.previous(lines, ["doc_id"], chunk, ["line_no"], {
        "__closed": (head | ln.ends_block(F.col("text")))})
    fresh = (head | starts | F.coalesce("__closed", F.lit(True))).cast("int")
    marked = before.withColumn("__fresh", fresh)
    out = scale.running(marked, ["doc_id"], chunk, ["line_no"], {"__n": F.col("__fresh")})
    return out.withColumn("par_no", (F.col("__n") + F.col("__fresh")).cast("long")).drop("__n", "__fresh", "__closed")


def paragraphs(numbered: DataFrame) -> DataFrame:
    """Joined text of each paragraph; a paragraph is one cell of text, so its lines fit one row."""
    lines = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    text = ln.join_lines(F.transform("__l", lambda x: x["text"]))
    return (numbered.groupBy("doc_id", "par_no").agg(lines.alias("__l"), F.max("heading_level").alias("heading_level"),
                                                     F.min("page").alias("page"))
            .select("doc_id", "par_no", "page", "heading_level", text.alias("text")))


def reading_order(blocks: DataFrame) -> DataFrame:
    """Number the blocks of each page: left column then right where both hold two or more, else by line."""
    left = F.col("x") < F.col("page_w") / 2 * 0.9
    b = scale.with_totals(blocks, ["doc_id", "page"], {"__l": F.count_if(left), "__r": F.count_if(~left)})
    two = (F.col("__l") >= 2) & (F.col("__r") >= 2)
    b = (b.withColumn("__side", F.when(two & ~left, 1).otherwise(0))
         .withColumn("__x", F.when(two, F.lit(0.0)).otherwise(F.col("x"))))
    chunk = {"__c1": F.col("__side"), "__c2": F.floor(F.col("y") / 50)}
    out = scale.running(b, ["doc_id", "page"], chunk, ["__side", "y", "__x", "block_no"], number="order_no")
    return out.drop("__l", "__r", "__side", "__x")


def join_words_by_gap(spans: DataFrame) -> DataFrame:
    """Glyph spans of a line to its text: a gap wider than a share of the em is a space.

    ``spans``: doc_id, line_no, parts ARRAY<STRUCT<text, x0, x1, size>> in order. The rule looks at neighbours only.
    """
    def part(p: Column, i: Column) -> Column:
        prev = F.try_element_at("parts", i)
        wide = (p["x0"] - prev["x1"]) > F.greatest(p["size"], prev["size"]) * ln.WORD_GAP
        space = wide & ~prev["text"].endswith(" ") & ~p["text"].startswith(" ")
        return F.concat(F.when(space, " ").otherwise(""), p["text"])

    joined = F.array_join(F.transform("parts", lambda p, i: F.when(i == 0, p["text"]).otherwise(
        part(p, F.greatest(i, F.lit(1))))), "")
    return spans.withColumn("text", ln.tighten_marks(ln.collapse_spaced_runs(ln.repair_ligatures(joined)))).drop("parts")


def bind_captions_nearest(events: DataFrame) -> DataFrame:
    """Captions claim the latest unclaimed asset of their kind within one page, each asset once.

    ``events``: doc_id, items ARRAY<STRUCT<pos, is_caption, kind, page, id>> in document order, one document per
    row. The fold carries the stack of unclaimed assets and emits the claim of each caption.
    """
    asset = "struct<kind:string,page:int,id:string>"
    state = f"struct<open:array<{asset}>,claim:string>"
    start = F.struct(F.array().cast(f"array<{asset}>").alias("open"), F.lit(None).cast("string").alias("claim"))

    def step(st: Column, e: Column) -> Column:
        fits = F.filter(st["open"], lambda a: (a["kind"] == e["kind"]) & (F.abs(a["page"] - e["page"]) <= 1))
        won = F.when(e["is_caption"], F.try_element_at(fits, F.lit(-1))["id"])
        me = F.struct(e["kind"].alias("kind"), e["page"].cast("int").alias("page"), e["id"].alias("id"))
        # Assets two pages back can never be claimed again, so the stack stays as small as two pages.
        near = F.filter(st["open"], lambda a: (a["page"] >= e["page"] - 1) & ~F.coalesce(a["id"] == won, F.lit(False)))
        return F.struct(F.when(e["is_caption"], near).otherwise(F.concat(near, F.array(me))).alias("open"),
                        won.alias("claim"))

    claims = scale.scan(F.col("items"), start, step, lambda st: st["claim"], state, "string")
    pairs = F.filter(F.zip_with("items", claims, lambda e, c: F.struct(
        e["pos"].alias("pos"), e["is_caption"].alias("cap"), c.alias("asset_id"))), lambda p: p["cap"])
    return events.select("doc_id", F.explode(pairs).alias("p")).select("doc_id", "p.pos", "p.asset_id")


def bind_captions_adjacent(events: DataFrame) -> DataFrame:
    """A caption binds to the latest asset above it when that one is uncaptioned and of its label; otherwise it waits
    for a table right below.

    ``events``: doc_id, items ARRAY<STRUCT<pos, kind, label, id>> in order; kind is caption, asset or other.
    """
    state = "struct<id:string,label:string,captioned:boolean,waiting:bigint,cap:bigint,bound:string>"
    no_text, no_pos = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    start = F.struct(no_text.alias("id"), no_text.alias("label"), F.lit(True).alias("captioned"),
                     no_pos.alias("waiting"), no_pos.alias("cap"), no_text.alias("bound"))

    def step(st: Column, e: Column) -> Column:
        asset, cap = e["kind"] == "asset", e["kind"] == "caption"
        below = asset & (e["label"] == "table") & st["waiting"].isNotNull()
        above = cap & ~st["captioned"] & F.coalesce(e["label"] == st["label"], F.lit(False))
        return F.struct(
            F.when(asset, e["id"]).otherwise(st["id"]).alias("id"),
            F.when(asset, e["label"]).otherwise(st["label"]).alias("label"),
            F.when(asset, below).otherwise(st["captioned"] | above).alias("captioned"),
            F.when(cap & ~above, e["pos"]).alias("waiting"),
            F.when(above, e["pos"]).when(below, st["waiting"]).alias("cap"),
            F.when(above, st["id"]).when(below, e["id"]).alias("bound"))

    run = scale.scan(F.col("items"), start, step, lambda st: F.struct(st["cap"], st["bound"]), state,
                     "struct<cap:bigint,bound:string>")
    return events.select("doc_id", F.explode(F.filter(run, lambda r: r["bound"].isNotNull())).alias("r")).select(
        "doc_id", F.col("r.cap").alias("seg_no"), "r.bound")


def explode_tables(tables: DataFrame) -> DataFrame:
    """Cells of table payloads (columns, rows), short rows padded: row_no 0 is the header."""
    width = F.greatest(F.size("columns"), F.aggregate("rows", F.lit(0), lambda a, r: F.greatest(a, F.size(r))))
    every = F.concat(F.array("columns"), F.col("rows"))
    padded = F.transform(every, lambda r: F.concat(r, F.array_repeat(F.lit(""), F.greatest(
        F.lit(0), F.col("__w") - F.size(r)))))
    return (tables.withColumn("__w", width).select("asset_id", F.posexplode(padded).alias("row_no", "cells"))
            .select("asset_id", "row_no", F.posexplode("cells").alias("col_no", "cell")))


# ---------------------------------------------------------------- typeset files


REFERENCE = r"\\(?:input|include)\s*\{([^}]*)\}"


def expand_includes(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Splice included files into their parents; returns (expanded, unresolved).

    ``files``: path, text. A file is spliced once all files it refers to are, so every text is written once and the rounds
    are as many as the files nest deep. What then still waits is a loop or leads to one: such references stay in the text.
    ``unresolved``: path, name, reason (``missing``, which leaves nothing in the text, or ``loop``). A reference names a
    path with or without its suffix; the path as it stands wins.
    """
    files = cut_lineage(files.select("path", "text"))  # read in every round
    named = files.select("path", F.posexplode(F.transform(F.regexp_extract_all("text", F.lit(REFERENCE), F.lit(1)), tx.strip)).alias("n", "name"))
    paths = files.select(F.col("path").alias("target")).distinct()
    want = named.select("*", F.explode(F.array("name", F.concat("name", F.lit(".tex")))).alias("target"))
    found = want.join(paths, "target").groupBy("path", "n").agg(F.min_by("target", F.length("target")).alias("target"))
    refs = cut_lineage(named.join(found, ["path", "n"], "left"))
    open_, closed = cut_lineage(files.select("path")), cut_lineage(files.select("path", "text").limit(0))

    def spliced(some: DataFrame) -> DataFrame:
        """The files of these paths with all closed targets in place; an open target's reference stays."""
        own = files.select("path", "text").join(some.select("path").distinct(), "path", "left_semi")
        # Small beside the texts: where it is sent to them, only the bodies that are spliced leave their place.
        want = cut_lineage(refs.join(some.select("path"), "path", "left_semi"))
        bodies = closed.select(F.col("path").alias("target"), F.col("text").alias("body"))
        found = (want.join(bodies, "target").select("path", "n", "body", F.lit(True).alias("known"))
                 .unionByName(want.join(bodies.select("target"), "target", "left_anti").select(
                     "path", "n", F.lit(None).cast("string").alias("body"), F.col("target").isNotNull().alias("known"))))
        body = found.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "body", "known"))), lambda x: F.struct(
            x["body"].alias("body"), x["known"].alias("known"))).alias("found"))
        said = F.regexp_extract_all("text", F.lit(REFERENCE), F.lit(0))
        into = F.zip_with(F.coalesce("found", F.array().cast("array<struct<body:string,known:boolean>>")), said,
                          lambda f, r: F.coalesce(f["body"], F.when(f["known"], r).otherwise("")))
        text = F.array_join(F.zip_with(F.split("text", REFERENCE, -1), into, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
        return own.join(body, "path", "left").select("path", text.alias("text"))

    while True:
        waits = refs.join(open_.select(F.col("path").alias("target")), "target", "left_semi").select("path").distinct()
        ready = cut_lineage(spliced(cut_lineage(open_.join(waits, "path", "left_anti"))))
        if ready.isEmpty():
            break
        closed = closed.unionByName(ready)  # every text is written once
        open_ = cut_lineage(open_.join(ready.select("path"), "path", "left_anti"))
    loops = refs.join(open_.select(F.col("path").alias("target")), "target", "left_semi").join(open_.select("path"), "path", "left_semi")
    unresolved = (refs.filter("target IS NULL").select("path", "name", F.lit("missing").alias("reason"))
                  .unionByName(loops.select("path", "name", F.lit("loop").alias("reason"))).distinct())
    return closed.unionByName(spliced(open_)), unresolved


TOKEN = (r"\\(?:begin\{[a-zA-Z*]+\}|end\{[a-zA-Z*]+\}|(?:part|chapter|section|subsection|subsubsection|paragraph)\*?"
         r"\s*(?:\[[^\]]*\])?\s*\{[^{}]*\})")
LISTS = ("itemize", "enumerate", "description")
MATHS = ("equation", "align", "gather", "multline", "eqnarray", "displaymath")
FLOATS = ("figure", "table", "wrapfigure")
VERBATIMS = ("verbatim", "lstlisting", "minted", "Verbatim")


def latex_blocks(docs: DataFrame) -> DataFrame:
    """Top-level blocks of typeset sources in order: sections, environments by class and the text between.

    The source is cut into tokens and the pieces between them; depth is a running count inside the row, and pieces
    at depth zero are the blocks.
    """
    body = lx.document_body(lx.strip_comments(F.col("text")))
    d = docs.select("doc_id", body.alias("__t"))
    toks = F.regexp_extract_all("__t", F.lit(f"(?s){TOKEN}"), F.lit(0))
    parts = F.zip_with(F.split("__t", f"(?s){TOKEN}"), toks, lambda a, t: F.struct(a.alias("text"), t.alias("tok")))
    state = "struct<depth:int,block:int,env:string,text:string,tok:string,inside:boolean>"
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("block"), F.lit("").alias("env"), F.lit("").alias("text"),
                     F.lit("").alias("tok"), F.lit(False).alias("inside"))

    def step(st: Column, p: Column) -> Column:
        opens, closes = p["tok"].startswith("\\begin"), p["tok"].startswith("\\end")
        name = F.regexp_extract(p["tok"], r"\{([a-zA-Z*]+)\}$", 1)
        depth = F.greatest(F.lit(0), st["depth"] + F.coalesce(opens.cast("int"), F.lit(0))
                           - F.coalesce(closes.cast("int"), F.lit(0)))
        inside = st["depth"] > 0
        return F.struct(depth.alias("depth"), (st["block"] + F.when(inside, 0).otherwise(1)).alias("block"),
                        F.when(inside, st["env"]).when(F.coalesce(opens, F.lit(False)), name).otherwise("").alias("env"),
                        p["text"].alias("text"), p["tok"].alias("tok"), inside.alias("inside"))

    run = scale.scan(F.col("parts"), start, step, lambda st: st, state, state)
    flat = d.withColumn("parts", parts).select("doc_id", F.posexplode(run).alias("pos", "r")).select(
        "doc_id", "pos", "r.*")
    # Read by three kinds of block, so the source is cut once and written rather than cut again for each.
    flat = cut_lineage(flat)
    # Free text and section titles stand outside any environment.
    free = flat.filter(~F.col("inside") & (tx.strip("text") != "")).select(
        "doc_id", (F.col("pos") * 2).alias("ord"), F.lit("text").alias("class"), F.lit(0).alias("level"),
        lx.strip_latex("text").alias("text"))
    cmd = F.regexp_extract("tok", r"^\\([a-z]+)", 1)
    levels = F.create_map(*[F.lit(x) for kv in lx.SECTION_LEVELS.items() for x in kv])
    title = lx.strip_latex(F.regexp_extract("tok", r"(?s)\{([^{}]*)\}$", 1))
    heads = flat.filter(~F.col("inside") & levels[cmd].isNotNull()).select(
        "doc_id", (F.col("pos") * 2 + 1).alias("ord"), F.lit("heading").alias("class"), levels[cmd].alias("level"),
        title.alias("text")).filter("text <> ''")
    name = F.translate("env", "*", "")
    kind = (F.when(name.isin(*LISTS), "list").when(name.isin(*MATHS), "equation").when(name.isin(*FLOATS), "float")
            .when(name.isin(*VERBATIMS), "code").when(name.isin("thebibliography", "abstract"), "skip").otherwise("other"))
    inner = F.concat("text", F.when(F.col("depth") > 0, F.coalesce("tok", F.lit(""))).otherwise(""))
    envs = (flat.filter("inside").groupBy("doc_id", F.col("block").alias("b"), "env").agg(
        F.min("pos").alias("p0"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", inner.alias("t")))),
                                                          lambda x: x["t"]), "").alias("raw"))
        .select("doc_id", (F.col("p0") * 2).alias("ord"), kind.alias("class"), F.lit(0).alias("level"),
                tx.flatten_space("raw").alias("text")))
    return free.unionByName(heads).unionByName(envs)


def list_levels(docs: DataFrame) -> DataFrame:
    """Items of nested lists with their depth, capped at three."""
    tok = r"\\begin\{(?:itemize|enumerate|description)\}|\\end\{(?:itemize|enumerate|description)\}|\\item\b"
    toks = F.regexp_extract_all("text", F.lit(tok), F.lit(0))
    rest = F.split("text", tok)
    parts = F.zip_with(F.slice(rest, F.lit(2), F.greatest(F.size(rest) - 1, F.lit(0))), toks,
                       lambda a, t: F.struct(a.alias("text"), t.alias("tok")))
    state = "struct<depth:int,text:string,item:boolean>"
    start = F.struct(F.lit(-1).alias("depth"), F.lit("").alias("text"), F.lit(False).alias("item"))

    def step(st: Column, p: Column) -> Column:
        move = F.when(p["tok"].startswith("\\begin"), 1).when(p["tok"].startswith("\\end"), -1).otherwise(0)
        return F.struct((st["depth"] + move).alias("depth"), p["text"].alias("text"), (move == 0).alias("item"))

    run = scale.scan(F.col("parts"), start, step, lambda st: st, state, state)
    clean = tx.flatten_space(tx.sub(F.col("r.text"), r"^\s*\[[^\]]*\]", ""))
    return (docs.withColumn("parts", parts).select("doc_id", F.posexplode(run).alias("pos", "r"))
            .filter("r.item").select("doc_id", "pos", F.least(F.greatest("r.depth", F.lit(0)), F.lit(3)).alias("level"),
                                     clean.alias("text")).filter("text <> ''"))
