import json

from briefloom.sources import deck_io as io


def deck(uid, n):
    blocks = [{"uid": f"{uid}b{i}", "type": "bullet", "content": f"c{i}", "importance": 0.5, "channel": "slide", "tags": []} for i in range(n)]
    return {"schema_version": "0.1", "uid": uid, "meta": {"title": "T", "language": "zh"}, "delivery": {"total_seconds": 480},
            "sections": [{"uid": uid + "s", "title": "S", "weight": 1.0, "slides": [{"uid": uid + "p", "role": "text_dense", "title": "P", "blocks": blocks}]}],
            "assets": [], "sources": [{"doc_id": "m", "char_count": 9}]}


def test_decks_round_trip(spark, tmp_path):
    src = tmp_path / "decks"
    src.mkdir()
    for uid, n in (("d1", 3), ("d2", 1)):
        (src / f"{uid}.json").write_text(json.dumps(deck(uid, n), indent=1))
    t = io.read_decks(spark, str(src))
    assert [r.content for r in t["blocks"].filter("deck_uid = 'd1'").orderBy("block_no").collect()] == ["c0", "c1", "c2"]
    io.write_decks(t, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out" / "blocks"))
    assert back.count() == 4 and back.exceptAll(t["blocks"]).count() == 0
    recs = spark.read.json(str(tmp_path / "out" / "slide_records"))
    assert sorted(len(r.blocks) for r in recs.collect()) == [1, 3]


def test_manuscripts_by_suffix(spark, tmp_path):
    (tmp_path / "a.tex").write_text("x\ny")
    (tmp_path / "b.odt").write_text("z")
    good, bad = io.read_manuscripts(spark, str(tmp_path))
    assert [(r.text, r.format) for r in good.collect()] == [("x\ny", "tex")]
    assert "supported: docx" in bad.head().reason


def test_edit_log(spark, tmp_path):
    log = {"deck_uid": "d", "patches": [{"patch_id": "p1", "created_at": "2024-01-01T00:00:00Z", "selection": [], "confidence": 0.9,
                                         "operations": [{"op": "pin", "target": "b1", "pinned": True}, {"op": "set_text", "target": "b2", "value": "v"}]}]}
    (tmp_path / "log.json").write_text(json.dumps(log, indent=1))
    ops = io.read_edit_log(spark, str(tmp_path / "log.json"))
    assert [(r.seq, r.op_no, r.op, r.target) for r in ops.orderBy("op_no").collect()] == [(0, 0, "pin", "b1"), (0, 1, "set_text", "b2")]
    io.write_edit_log(ops, str(tmp_path / "out"))
    assert len(spark.read.json(str(tmp_path / "out")).head().operations) == 2


def test_includes_nest_deep_and_loops_are_reported(spark):
    from briefloom.operators import structure as st

    files = [(f"f{i}.tex", f"{i} \\input{{f{i + 1}}}") for i in range(8)] + [("f8.tex", "8\\include{ nowhere }.")]
    files += [("a.tex", "a \\input{b.tex} \\input{f8}"), ("b.tex", "b \\input{a}"), ("c.tex", "c \\input{a} \\input{f7}"), ("none.tex", "")]
    out, left = st.expand_includes(spark.createDataFrame(files, "path string, text string"))
    got = {r.path: r.text for r in out.collect()}
    assert got["f0.tex"] == "0 1 2 3 4 5 6 7 8." and got["f8.tex"] == "8." and got["none.tex"] == ""
    assert got["a.tex"] == "a \\input{b.tex} 8." and got["c.tex"] == "c \\input{a} 7 8."
    assert {tuple(r) for r in left.collect()} == {("f8.tex", "nowhere", "missing"), ("a.tex", "b.tex", "loop"), ("b.tex", "a", "loop"), ("c.tex", "a", "loop")}


def test_included_texts_are_written_once(spark, monkeypatch):
    from briefloom.operators import structure as st

    files = [(f"f{i}.tex", f"{i} \\input{{f{i + 1}}}") for i in range(8)] + [("f8.tex", "8.")]
    keep, written = st.cut_lineage, []

    def counted(df):
        out = keep(df)
        written.append(out.count() if "text" in out.columns else 0)
        return out

    monkeypatch.setattr(st, "cut_lineage", counted)
    out, left = st.expand_includes(spark.createDataFrame(files, "path string, text string"))
    assert {r.path: r.text for r in out.collect()}["f0.tex"] == "0 1 2 3 4 5 6 7 8." and left.count() == 0
    assert sum(written) == 2 * len(files)  # as given and as spliced
