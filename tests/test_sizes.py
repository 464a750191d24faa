"""What a query does once, on all cores, or on few rows, as its plan and its written tables show."""

from __future__ import annotations

import re
import pytest
from pyspark.sql import functions as F

from briefloom.functions import latex as lx
from briefloom.functions import measure as ms
from briefloom.functions import text as tx
from briefloom.operators import provenance as pv
from briefloom.operators import structure as st
from briefloom.plans import plan as pn
from briefloom.plans import repair
from briefloom.queries import pages


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_width_searches_long_classes_beyond_ascii_only(spark):
    """F14"""
    texts = ["a 1", "研究 12", "é٣１ x", "", "²½ 七", None, "😀１ 9"]
    one = lambda t: sum(ms.WIDE_EM if ms.is_wide(ch) else ms.SPACE_EM if ch == " " else ms.DIGIT_EM if ch.isdigit() else ms.LETTER_EM for ch in t)
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ms.class_em(F.col("t")).alias("w"))
    assert {r.t: r.w for r in df.collect()} == {t: None if t is None else one(t) for t in texts}
    assert "regexp_count" not in plan_of(df).lower() and "regexp_extract_all" not in plan_of(df)


def test_slots_use_all_cores(spark, tmp_path):
    """F17"""
    spark.range(40).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    out = pages.slot_capacity(spark, str(tmp_path))
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert out.count() == 40


@pytest.mark.parametrize("text", ["plain words", "a  b", "a \nb", "a\n\n\nb", "a\tb", "a\r\nb", "a\u00a0b", "\u200b", "e\u0301 x", " \x1f\u200b ", "研究\u3000方法", "", None])
def test_normalised_as_before(spark, text):
    """F16, F21"""
    import re
    import unicodedata

    def slow(t):
        t = re.sub(r"\r\n?", "\n", re.sub(f"[{tx.INVISIBLE}]", "", unicodedata.normalize("NFC", t or "")))
        t = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", re.sub(r"[ \t\u00a0\u2000-\u200a\u3000]+", " ", t)))
        return t.strip(tx.SPACE_CHARS)

    row = spark.createDataFrame([(text,)], "t string").select(tx.normalize_text("t").alias("n"), tx.has_content("t").alias("h")).first()
    assert row.n == slow(text) and bool(row.h) == (slow(text) != "")


def test_changed_sources_cleans_a_text_once(spark):
    """F16: looking for null digests first would clean every text before it is spread."""
    rows = spark.createDataFrame([(1, "a  b"), (2, "c"), (3, None)], "doc_id long, text string").repartition(2)
    later = rows.withColumn("text", F.when(F.col("doc_id") != 1, F.lit("d")).otherwise(F.lit("a b")))
    out = pv.changed_sources(rows, later)
    assert "isnotnull(sha2" not in plan_of(out)
    assert sorted(r.doc_id for r in out.collect()) == [2, 3]


def test_offsets_move_no_text(spark):
    """F21"""
    rows = [(d, i, t) for d in (1, 2, None) for i, t in enumerate(["ab", " \u200b", "c  d", None, "e"], 1)]
    segs = spark.createDataFrame(rows, "doc_id long, seg_no long, text string")
    out = pv.assign_offsets(segs).select("doc_id", "seg_no", "start", "end")
    found = sorted((r.doc_id or 0, r.seg_no, r.start, r.end) for r in out.collect())
    assert found == [(d, n, s, e) for d in (0, 1, 2) for n, s, e in ((1, 0, 2), (3, 4, 7), (5, 9, 10))]
    windows = [line for line in plan_of(out).splitlines() if "Window" in line]
    assert windows and not any("text#" in line for line in windows)


def test_typeset_blocks_cut_the_source_once(spark):
    """F15"""
    src = r"\section{One} a\% b % gone" + "\n" + r"\begin{itemize}\item x\end{itemize} tail \begin{equation}y\end{equation}"
    out = st.latex_blocks(spark.createDataFrame([(1, src), (2, "only words"), (3, None)], "doc_id long, text string"))
    assert "regexp_extract_all(__t" not in plan_of(out)
    assert sorted((r.doc_id, r["class"], r.level, r.text) for r in out.collect()) == [
        (1, "equation", 0, "y"), (1, "heading", 1, "One"), (1, "list", 0, r"\item x"), (1, "text", 0, "a% b"), (1, "text", 0, "tail"), (2, "text", 0, "only words")]


def test_prose_without_signs_reads_as_tokens_do(spark):
    """F15"""
    texts = {"a  b\n c ": "a b c", "": "", " \x01x ": "x", r"\& y": "& y", "100%": "100%", "~": "", "a_b": "a_b"}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", lx.strip_latex("t").alias("p"))
    assert {r.t: r.p for r in df.collect()} == texts


def test_sections_are_planned_once(spark):
    """F19, F22"""
    seg = "struct<seg_no:bigint,kind:string,text:string,level:int,asset_id:string>"
    docs = spark.createDataFrame([(1, "T", ["A"], [(1, "heading", "One", 1, None), (2, "paragraph", "Some words here.", 0, None)])],
                                 f"doc_id long, title string, authors array<string>, segs array<{seg}>")
    planned = pn.plan_documents(docs, 900)
    assert [(r.section_no, r.pages) for r in planned.sections.collect()] == [(1, 1)]
    assert "page_list" not in plan_of(planned.sections) and "blocks" not in plan_of(planned.navigation)
    assert {r.role for r in planned.navigation.collect()} == {"cover", "acknowledgement"}


def test_planned_blocks_are_written_once(spark):
    """pages and merged blocks read the written rows; no segment is cut and scored again."""
    seg = "struct<seg_no:bigint,kind:string,text:string,level:int,asset_id:string>"
    docs = spark.createDataFrame([(1, "T", ["A"], [(1, "heading", "One", 1, None), (2, "paragraph", "Some words here.", 0, None), (3, "table", "t", 0, "tbl-3"),
                                                   (4, "caption", "Table 3: sizes", 0, "tbl-3")])], f"doc_id long, title string, authors array<string>, segs array<{seg}>")
    planned = pn.plan_documents(docs, 900)
    for table in (planned.blocks, planned.slides):
        assert "segs" not in plan_of(table)
    got = sorted((r.page, r.asset_id or "", r.seg_no, r.type, r.content, [x.seg_no for x in r.spans]) for r in planned.blocks.collect())
    assert got == [(1, "", 2, "bullet", "Some words here.", [2]), (2, "tbl-3", 3, "table", "Table 3: sizes", [3, 4])]
    assert [(r.page, r.segments) for r in planned.slides.orderBy("page").collect()] == [(1, 1), (2, 2)]


def test_repair_rounds_write_only_the_pages_that_gave(spark, monkeypatch):
    """F18"""
    slides = spark.createDataFrame([(1, 1, n, n, False) for n in range(1, 21)], "deck_uid long, section_no int, slide_uid long, slide_no long, is_backup boolean")
    blocks = spark.createDataFrame([(n, f"{n}.{k}", k, "bullet", "slide", False, False, 10 * k, 50 if n == 3 else 10, "wide " * 9)
                                    for n in range(1, 21) for k in (1, 2, 3)],
                                   "slide_uid long, block_uid string, line_no int, type string, channel string, pinned boolean, channel_pinned boolean, "
                                   "importance_milli int, units int, content string")
    written = []
    cut = repair.cut_lineage

    def counted(df):
        out = cut(df)
        written.append((df.columns, out.count()))
        return out

    monkeypatch.setattr(repair, "cut_lineage", counted)
    after, moves = repair.overflow_repair(slides, blocks, F.struct("line_no"), repair.over_by_units(F.lit(60)))
    assert sorted((r.slide_uid, r.block_uid, r["round"]) for r in moves.collect()) == [(3, "3.1", 1), (3, "3.2", 2)]
    assert after.filter("channel = 'script' AND channel_pinned").count() == 2 and after.count() == 60 and after.columns[0] == "block_uid"
    assert not any("content" in names or ("units" in names and rows > 3) for names, rows in written)


def test_lines_become_segments(spark):
    """the pieces of a paragraph are numbered by a column that the helpers leave alone."""
    from briefloom.plans import segment

    lines = [(1, "1. Methods", 20.0), (2, "We tried two ways: all of them", 10.0), (3, "were slow.", 10.0), (4, "(1) first way (2) second way", 10.0),
             (5, "References", 20.0), (6, "[1] A. Author.", 10.0)]
    rows = [(d, 1, n, t, z, False) for d in (7, 8) for n, t, z in lines]
    out = segment.segment_documents(spark.createDataFrame(rows, "doc_id long, page int, line_no long, text string, size double, bold boolean")).collect()
    for d in (7, 8):
        mine = sorted((r for r in out if r.doc_id == d), key=lambda r: r.seg_no)
        assert [(r.seg_no, r.kind, r.text) for r in mine] == [
            (1, "heading", "Methods"), (2, "paragraph", "We tried two ways: all of them were slow."), (3, "list_item", "(1) first way"),
            (4, "list_item", "(2) second way"), (5, "heading", "References"), (6, "reference", "[1] A. Author.")]
        assert "\n\n".join(r.text for r in mine)[mine[3].start:mine[3].end] == "(2) second way"


def moved(df) -> int:
    """Shuffles of the plan, with joins that do not broadcast."""
    conf, key = df.sparkSession.conf, "spark.sql.autoBroadcastJoinThreshold"
    old = conf.get(key)
    conf.set(key, "-1")
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    finally:
        conf.set(key, old)


def test_places_on_a_page_are_numbered_in_one_shuffle(spark, monkeypatch):
    """F9, F10, F12"""
    from briefloom import scale
    from briefloom.operators import requests as rq

    rows = [(f"s{s}" if s else None, f"{s}.{i}", i, "script" if i % 5 == 4 else "slide", (None, "table", "bullet", "bullet", "figure")[(i * 7 + s) % 5],
             (None, True, False)[(i + s) % 3], None if i % 8 == 7 else 100 * (i % 4)) for s in range(4) for i in range(1, 12 + s)]
    blocks = spark.createDataFrame(rows, "slide_uid string, block_uid string, block_no long, channel string, type string, pinned boolean, importance_milli int")
    got = rq.numbered_body(blocks)
    assert moved(got) == 1
    few = scale.large_groups
    monkeypatch.setattr(rq.scale, "large_groups", lambda df, keys: few(df, keys, 0))  # every page cut into chunks
    chunked = rq.numbered_body(blocks)
    assert sorted(map(str, got.select(chunked.columns).collect())) == sorted(map(str, chunked.collect()))


def test_only_substrings_that_may_be_needles_leave_their_row(spark):
    """every substring used to be dealt."""
    from briefloom import scale

    hay = spark.createDataFrame([("d", i, f"item {i} of a longer text 创新") for i in range(50)], "k string, id int, t string")
    needles = spark.createDataFrame([("d", "创新"), ("d", "点"), ("e", "it"), ("d", None)], "k string, n string")
    out = scale.contains_join(hay, "t", needles, "n", ["k"])
    assert out.count() == 50
    node = out._jdf.queryExecution().optimizedPlan().toString().split("Generate explode(")[1]
    assert node.startswith("filter(") and "array_contains" in node.split("\n")[0]


def test_blocks_of_decks_nobody_speaks_to_are_not_written(spark, tmp_path):
    """and a page that two decks share keeps its blocks in both."""
    from briefloom.queries import requests as qr

    spark.createDataFrame([(10, 1), (10, 2), (11, 1), (12, 3), (13, None)], "o_orderkey long, o_custkey long").selectExpr(
        "*", "'F' AS o_orderstatus", "'1-U' AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, n, 9 * n, 1, 2.0, 3.5, 0.05, "A") for k in (10, 11, 12, 13, None) for n in (2, 1)],
                          "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, "
                          "l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 1), (2, 7), (3, None)], "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(4, 1, "user", "a"), (3, 1, "system", "b")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    whole = qr.blocks(spark, str(tmp_path))
    near = qr.blocks(spark, str(tmp_path), qr.spoken_to(spark, str(tmp_path)))
    want = [r for r in whole.collect() if r.slide_uid in ("10", "11")]
    assert len(want) == 6 and sorted(map(str, near.collect())) == sorted(map(str, want))
    said = qr.utterances(spark, str(tmp_path))
    assert all(f.rsplit("/", 2)[1].startswith("cut-") for f in said.inputFiles()) and said.count() == 4


def exchanged(df) -> list[list[str]]:
    """The columns of every shuffle that ran when the rows were collected."""
    df.collect()
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    ran = set(re.findall(r"\((\d+)\)", text.partition("== Final Plan ==")[2].partition("== Initial Plan ==")[0]))
    found = re.findall(r"\((\d+)\) Exchange\s*\nInput \[\d+\]: \[([^\]]*)\]", text)
    return [re.findall(r"(\w+)#", columns) for n, columns in found if n in ran]


def test_merged_texts_move_once(spark):
    """what an edit names is looked up by uid alone, and texts move to their slide; rows that come twice count twice."""
    from briefloom.operators import edits as ed

    of = "slide_uid string, block_uid string, block_no long, content string, derivation string, spans array<struct<doc_id:int,start:long>>"
    rows = [(s, f"{s}.{k}", k, f"{s}{k}", "verbatim", [(1, k)]) for s in "pqr" for k in range(1, 5)]
    blocks = spark.createDataFrame([*rows, rows[-1], rows[-1]], of)
    ops = spark.createDataFrame([(1, "p.2", ["p.4", "p.1"]), (2, "q.1", ["r.1"]), (3, "q.3", ["nothing"]), (4, "r.4", ["r.2"]), (4, "r.4", ["r.2"])],
                                "op_id int, target string, others array<string>")
    conf, key = spark.conf, "spark.sql.autoBroadcastJoinThreshold"
    conf.set(key, "-1")
    try:
        out, refused = ed.merge_blocks(blocks, ops)
        moves = [c for c in exchanged(out) if "content" in c]
    finally:
        conf.unset(key)
    assert len(moves) == 1
    got = sorted((r.slide_uid, r.block_no, r.content, r.derivation) for r in out.collect())
    long = "; ".join(["r4"] * 6 + ["r2"] * 2)
    assert got == sorted([("p", 1, "p2; p4; p1", "synthesized"), ("p", 2, "p3", "verbatim"), *[("q", k, f"q{k}", "verbatim") for k in range(1, 5)],
                          ("r", 1, "r1", "verbatim"), ("r", 2, "r3", "verbatim"), *[("r", n, long, "synthesized") for n in (3, 4, 5)]])
    assert sorted((r.op_id, r.target) for r in refused.collect()) == [(2, "q.1"), (3, "q.3")]
