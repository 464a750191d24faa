"""The staged application of a log against a plain fold, patch by patch."""

import copy
import random

import pytest
from pyspark.sql import functions as F

from briefloom.plans import replay as rp
from briefloom.session import cut_lineage


@pytest.fixture(autouse=True, scope="module")
def interpreted(spark):
    """Many plans over a few rows each: compiling them would take most of the time."""
    settings = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


SLIDES = ("deck_uid string, section_uid string, slide_uid string, slide_no double, title string, role string, is_backup boolean, "
          "dwell_seconds double, dwell_locked boolean")
BLOCKS = ("deck_uid string, slide_uid string, block_uid string, block_no long, type string, content string, channel string, "
          "channel_pinned boolean, pinned boolean, importance_milli int, derivation string, spans array<struct<doc_id:string,start:int>>, "
          "speaker_note string, word_budget int")
OPS = ("deck_uid string, seq long, op_no int, patch_id long, op string, target string, value string, hard boolean, max_units int, "
       "parts array<string>, others array<string>, to_slide string, index int, position string, order array<string>, after_block string")


class Bad(Exception):
    pass


def find(deck, uid):
    for s, blocks in deck.items():
        for i, b in enumerate(blocks):
            if b["uid"] == uid:
                return s, i, b
    raise Bad(uid)


def fold_op(deck, o):
    s, i, b = find(deck, o["target"])
    if o["op"] == "set_text":
        if not o["value"].strip():
            raise Bad
        b["content"] = o["value"]
    elif o["op"] == "set_channel":
        b["channel"] = o["value"]
    elif o["op"] == "delete_block":
        if o["hard"]:
            deck[s].pop(i)
        else:
            b["channel"] = "drop"
    elif o["op"] == "split_block":
        parts = [p.strip() for p in o["parts"] if p.strip()]
        if len(parts) < 2:
            raise Bad
        b["content"] = parts[0]
        deck[s][i + 1:i + 1] = [{**b, "uid": None, "content": p} for p in parts[1:]]
    elif o["op"] == "merge_blocks":
        others = [find(deck, u) for u in o["others"]]
        if any(x[0] != s for x in others):
            raise Bad
        b["content"] = "; ".join([b["content"], *(x[2]["content"] for x in others)])
        deck[s] = [x for x in deck[s] if x["uid"] is None or x["uid"] not in o["others"]]
    elif o["op"] == "move_block":
        if o["to_slide"] not in deck:
            raise Bad
        deck[s].pop(i)
        deck[o["to_slide"]].insert(min(o["index"], len(deck[o["to_slide"]])), b)


def make(rnd):
    decks = {d: {f"{d}s{s}": [dict(uid=f"{d}s{s}b{b}", content=f"t {d}{s}{b}", channel="slide") for b in range(4)] for s in range(3)}
             for d in ("A", "B", "C")}
    log, seq = [], 0
    for d in decks:
        uids = [b["uid"] for bl in decks[d].values() for b in bl] + ["nowhere"]
        for _ in range(4 if d != "C" else 3):
            seq += 1
            for n in range(rnd.choice([1, 1, 2])):
                op = rnd.choice(["set_text", "set_channel", "delete_block", "split_block", "merge_blocks", "move_block"] if d != "C"
                                else ["set_text", "set_channel"])
                t = rnd.choice(uids)
                o = dict(deck_uid=d, seq=seq, op_no=n + 1, patch_id=seq, op=op, target=t, value=f"v{seq}.{n}", hard=None, max_units=None,
                         parts=None, others=None, to_slide=None, index=None, position=None, order=None, after_block=None)
                if op == "set_channel":
                    o["value"] = rnd.choice(["slide", "script"])
                elif op == "delete_block":
                    o["hard"] = rnd.random() < 0.6
                elif op == "split_block":
                    o["parts"] = rnd.choice([["x", "y", "z"], ["only"]])
                elif op == "merge_blocks":
                    o["others"] = [u for u in rnd.sample([x for x in uids if x[:3] == t[:3] and x != t], 1)] if t != "nowhere" else ["q"]
                elif op == "move_block":
                    o["to_slide"], o["index"] = rnd.choice([*decks[d], "nowhere"]), rnd.randrange(4)
                log.append(o)
    return decks, log


def test_log_equals_plain_fold(spark):
    decks, log = make(random.Random(11))
    slides = [(d, d + "sec", s, float(i), s, "text_dense", False, None, False) for d, ss in decks.items() for i, s in enumerate(ss)]
    blocks = [(d, s, b["uid"], i + 1, "bullet", b["content"], b["channel"], False, False, 500, "verbatim", [("m", 1)], None, None)
              for d, ss in decks.items() for s, bl in ss.items() for i, b in enumerate(bl)]
    cols = [c.split()[0] for c in OPS.split(", ")]
    ops = spark.createDataFrame([tuple(o[c] for c in cols) for o in log], OPS)
    after, refused = rp.apply_patches(rp.Decks(spark.createDataFrame(slides, SLIDES), spark.createDataFrame(blocks, BLOCKS)), ops)

    want_refused = set()
    for seq in sorted({o["seq"] for o in log}):
        patch = sorted((o for o in log if o["seq"] == seq), key=lambda o: o["op_no"])
        d = patch[0]["deck_uid"]
        trial = copy.deepcopy(decks[d])
        try:
            for o in patch:
                fold_op(trial, o)
            decks[d] = trial
        except Bad:
            want_refused.add(seq)
    want = sorted((s, i + 1, b["content"], b["channel"]) for ss in decks.values() for s, bl in ss.items() for i, b in enumerate(bl))
    got = sorted((r.slide_uid, r.block_no, r.content, r.channel) for r in after.blocks.collect())
    assert {r.patch_id for r in refused.collect()} == want_refused
    assert got == want


# ------------------------------------------------------------- all kinds of edit

KINDS = ("set_text", "rewrite", "split_block", "merge_blocks", "delete_block", "insert_block", "set_channel", "set_importance", "pin", "set_dwell", "retime",
         "move_block", "reorder_slides", "split_slide", "set_slide_role", "set_backup", "set_title", "replace_asset", "set_caption", "set_style")
FULL = OPS + (", separator string, asset_ref string, subtitle string, layout_hint string, total_seconds int, density string, font_size_pt double, "
              "emphasis string, new_derivation string")


def full_deck(d):
    """A deck as nested lists: two sections of two pages, figures on the last page."""
    block = lambda s, i: dict(uid=f"{s}b{i}", type="figure" if i > 2 and s.endswith("1") else "bullet", content=f"t {s}{i}", channel="slide", fixed=False, pinned=False,
                              imp=500, derivation="verbatim", asset=None, tags=["size:9", "keep"])
    page = lambda s: dict(uid=s, title=s, subtitle=None, role="text_dense", hint=None, backup=False, dwell=None, locked=False, blocks=[block(s, i) for i in range(4)])
    return dict(uid=d, total=300, density="normal", assets={f"{d}a": "old"},
                sections=[dict(uid=f"{d}x{n}", title=f"sec {n}", slides=[page(f"{d}x{n}s{i}") for i in range(2)]) for n in range(2)])


def fold_any(deck, o):
    pages = {s["uid"]: (sec, s) for sec in deck["sections"] for s in sec["slides"]}
    blocks = {b["uid"]: (s, b) for _, s in pages.values() for b in s["blocks"] if b["uid"]}
    kind, t = o["op"], o["target"]

    def need(ok):
        if not ok:
            raise Bad

    def block():
        need(t in blocks)
        return blocks[t]

    def page():
        need(t in pages)
        return pages[t][1]

    if kind == "set_text":
        _, b = block()
        need(o["value"].strip())
        b["content"], b["derivation"] = o["value"], "authored" if b["derivation"] in ("verbatim", "compressed") else b["derivation"]
    elif kind == "rewrite":
        block()  # every text here fits its limit already
    elif kind == "split_block":
        s, b = block()
        parts = [p.strip() for p in o["parts"] if p.strip()]
        need(len(parts) > 1)
        b["content"] = parts[0]
        at = s["blocks"].index(b) + 1
        s["blocks"][at:at] = [{**b, "uid": None, "content": p} for p in parts[1:]]
    elif kind == "merge_blocks":
        s, b = block()
        need(all(u in blocks and blocks[u][0] is s for u in o["others"]))
        b["content"] = (o["separator"] or "; ").join([b["content"], *(blocks[u][1]["content"] for u in o["others"])])
        s["blocks"] = [x for x in s["blocks"] if x["uid"] not in o["others"] or x["uid"] is None]
    elif kind == "delete_block":
        s, b = block()
        if o["hard"]:
            s["blocks"].remove(b)
        else:
            b["channel"] = "drop"
    elif kind == "insert_block":
        need((o["new_derivation"] or "authored") in ("authored", "inferred"))
        new = dict(uid=None, type="bullet", content=o["value"], channel="slide", fixed=False, pinned=False, imp=500, derivation=o["new_derivation"] or "authored", asset=None, tags=None)
        if t in pages:
            pages[t][1]["blocks"].append(new)
        else:
            s, b = block()
            at = s["blocks"].index(b)
            s["blocks"].insert({"before": at, "after": at + 1, "append": len(s["blocks"])}[o["position"] or "after"], new)
    elif kind == "set_channel":
        _, b = block()
        need(not (b["type"] == "figure" and o["value"] == "script"))
        b["channel"], b["fixed"] = o["value"], True
    elif kind == "set_importance":
        _, b = block()
        need(0 <= float(o["value"]) <= 1000)
        b["imp"] = int(o["value"])
    elif kind == "pin":
        block()[1]["pinned"] = o["value"] == "true"
    elif kind == "set_dwell":
        s = page()
        need(float(o["value"]) > 0)
        s["dwell"], s["locked"] = float(o["value"]), True
    elif kind == "retime":
        need(t == deck["uid"])
        deck["total"], deck["density"] = o["total_seconds"] or deck["total"], o["density"] or deck["density"]
    elif kind == "move_block":
        s, b = block()
        need(o["to_slide"] in pages)
        s["blocks"].remove(b)
        to = pages[o["to_slide"]][1]["blocks"]
        to.insert(len(to) if o["index"] is None else min(o["index"], len(to)), b)
    elif kind == "reorder_slides":
        sec = next((x for x in deck["sections"] if x["uid"] == t), None)
        need(sec and sorted(o["order"]) == sorted(str(s["uid"]) for s in sec["slides"]))
        sec["slides"] = [pages[u][1] for u in o["order"]]
    elif kind == "split_slide":
        s = page()
        uids = [b["uid"] for b in s["blocks"]]
        need(o["after_block"] in uids and uids.index(o["after_block"]) < len(uids) - 1)
        cut = uids.index(o["after_block"]) + 1
        new = {**s, "uid": None, "title": None, "dwell": None, "locked": False, "blocks": s["blocks"][cut:]}
        s["blocks"] = s["blocks"][:cut]
        at = pages[t][0]["slides"]
        at.insert(at.index(s) + 1, new)
    elif kind == "set_slide_role":
        s = page()
        s["role"], s["hint"] = o["value"], o["layout_hint"] or s["hint"]
    elif kind == "set_backup":
        page()["backup"] = o["value"] == "true"
    elif kind == "set_title":
        if t in pages:
            s = pages[t][1]
            s["title"], s["subtitle"] = o["value"], o["subtitle"] or s["subtitle"]
        else:
            sec = next((x for x in deck["sections"] if x["uid"] == t), None)
            need(sec)
            sec["title"] = o["value"]
    elif kind == "replace_asset":
        _, b = block()
        need(o["asset_ref"] in deck["assets"] and b["type"] == "figure")
        b["asset"] = o["asset_ref"]
    elif kind == "set_caption":
        if t in deck["assets"]:
            deck["assets"][t] = o["value"]
        else:
            _, b = block()
            need(b["type"] == "figure")
            b["content"] = o["value"]
    elif kind == "set_style":
        _, b = block()
        size = [f"size:{o['font_size_pt']:g}"] if o["font_size_pt"] else []
        b["tags"] = [x for x in b["tags"] or [] if x == "keep"] + size + ([f"emphasis:{o['emphasis']}"] if o["emphasis"] not in (None, "none") else [])


def any_log(rnd, decks, patches):
    log, seq = [], 0
    for _ in range(patches):
        for d, deck in decks.items():
            seq += 1
            slides = [f"{d}x{n}s{i}" for n in range(2) for i in range(2)]
            blocks = [f"{s}b{i}" for s in slides for i in range(4)]
            figures = [b for b in blocks if b.endswith("1b3")]
            for n in range(rnd.choice([1, 1, 1, 2])):
                kind = KINDS[(seq * 7 + n * 3) % 20]
                t = (d if kind == "retime" else f"{d}x{rnd.randrange(2)}" if kind == "reorder_slides" else rnd.choice(slides) if kind in (
                    "set_dwell", "split_slide", "set_slide_role", "set_backup") else rnd.choice([*slides, f"{d}x0"]) if kind == "set_title"
                    else rnd.choice([*figures, f"{d}a"]) if kind in ("set_caption", "replace_asset") else rnd.choice(blocks))
                o = dict.fromkeys(c.split()[0] for c in FULL.split(", ")) | dict(deck_uid=d, seq=seq, op_no=n + 1, patch_id=seq, op=kind, target=t, value=f"v{seq}.{n}")
                if rnd.random() < 0.04:
                    o["target"] = "nowhere"
                o |= {"set_channel": lambda: dict(value=rnd.choice(["slide", "script", "drop"])), "set_importance": lambda: dict(value=str(rnd.choice([10, 900, 2000]))),
                      "pin": lambda: dict(value=rnd.choice(["true", "false"])), "set_dwell": lambda: dict(value=rnd.choice(["30", "45.5", "0"])),
                      "retime": lambda: rnd.choice([dict(total_seconds=480), dict(density="sparse"), dict(total_seconds=99, density="dense")]),
                      "set_backup": lambda: dict(value=rnd.choice(["true", "false"])), "delete_block": lambda: dict(hard=rnd.random() < 0.4),
                      "split_block": lambda: dict(parts=rnd.choice([["x", "y", "z"], ["only"]])), "rewrite": lambda: dict(max_units=500),
                      "merge_blocks": lambda: dict(others=[rnd.choice([b for b in blocks if b != t])], separator=rnd.choice([None, " + "])),
                      "move_block": lambda: dict(to_slide=rnd.choice([*slides, "nowhere"]), index=rnd.choice([None, 0, 2])),
                      "insert_block": lambda: dict(position=rnd.choice([None, "before", "append"]), new_derivation=rnd.choice([None, "inferred", "verbatim"])),
                      "reorder_slides": lambda: dict(order=rnd.choice([[f"{t}s1", f"{t}s0"], [f"{t}s1"]])), "split_slide": lambda: dict(after_block=f"{t}b{rnd.randrange(4)}"),
                      "set_title": lambda: dict(subtitle=rnd.choice([None, "sub"])), "set_slide_role": lambda: dict(value="two_column", layout_hint=rnd.choice([None, "wide"])),
                      "replace_asset": lambda: dict(asset_ref=rnd.choice([f"{d}a", "none"])),
                      "set_style": lambda: dict(font_size_pt=rnd.choice([None, 12.0, 10.5]), emphasis=rnd.choice([None, "bold", "none"]))}.get(kind, dict)()
                log.append(o)
    return log


def tables(spark, decks):
    pages = [(d, sec["uid"], s["uid"], float(i + 10 * n), s["title"], s["role"], s["backup"], s["dwell"], s["locked"]) for d, k in decks.items()
             for n, sec in enumerate(k["sections"]) for i, s in enumerate(sec["slides"])]
    blocks = [(d, s["uid"], b["uid"], i + 1, b["type"], b["content"], b["channel"], b["fixed"], b["pinned"], b["imp"], b["derivation"], [], None, None, b["tags"])
              for d, k in decks.items() for sec in k["sections"] for s in sec["slides"] for i, b in enumerate(s["blocks"])]
    return rp.Decks(cut_lineage(spark.createDataFrame(pages, SLIDES).coalesce(1)), spark.createDataFrame(blocks, BLOCKS + ", tags array<string>"),
                    spark.createDataFrame([(d, sec["uid"], sec["title"]) for d, k in decks.items() for sec in k["sections"]], "deck_uid string, section_uid string, title string"),
                    spark.createDataFrame([(d, a, c) for d, k in decks.items() for a, c in k["assets"].items()], "deck_uid string, asset_uid string, caption string"),
                    spark.createDataFrame([(d, k["total"], k["density"], None) for d, k in decks.items()], "deck_uid string, total_seconds int, density string, target_dwell_seconds double"))


def folded(decks, log):
    decks, refused = copy.deepcopy(decks), set()
    for seq in sorted({o["seq"] for o in log}):
        patch = sorted((o for o in log if o["seq"] == seq), key=lambda o: o["op_no"])
        trial = copy.deepcopy(decks[patch[0]["deck_uid"]])
        try:
            for o in patch:
                fold_any(trial, o)
            decks[patch[0]["deck_uid"]] = trial
        except Bad:
            refused.add(seq)
    return decks, refused


def test_all_kinds_equal_a_plain_fold(spark):
    decks = {f"D{i}": full_deck(f"D{i}") for i in range(8)}
    log = any_log(random.Random(5), {d: k for d, k in decks.items() if d != "D7"}, 3)
    assert {o["op"] for o in log} == set(KINDS)
    cols = [c.split()[0] for c in FULL.split(", ")]
    ops = spark.createDataFrame([tuple(o[c] for c in cols) for o in log], FULL)
    after, refused = rp.apply_patches(tables(spark, decks), ops)
    want, bad = folded(decks, log)
    assert {r.patch_id for r in refused.collect()} == bad and 0 < len(bad) < len({o["seq"] for o in log})

    slides = sorted(after.slides.collect(), key=lambda r: (r.deck_uid, r.section_uid, r.slide_no))
    pages = [(d, sec["uid"], s) for d, k in sorted(want.items()) for sec in k["sections"] for s in sec["slides"]]
    assert len(slides) == len(pages)
    place = {}
    for r, (d, sec, s) in zip(slides, pages, strict=True):
        assert (r.deck_uid, r.section_uid, r.subtitle, r.role, r.layout_hint, r.is_backup, r.dwell_seconds, r.dwell_locked) == (
            d, sec, s["subtitle"], s["role"], s["hint"], s["backup"], s["dwell"], s["locked"])
        assert s["uid"] is None or (r.slide_uid, r.title) == (s["uid"], s["title"])
        place[r.slide_uid] = s
    blocks = sorted(after.blocks.collect(), key=lambda r: (r.slide_uid, r.block_no))
    got = {}
    for r in blocks:
        got.setdefault(r.slide_uid, []).append((r.type, r.content, r.channel, r.channel_pinned, r.pinned, r.importance_milli, r.derivation, r.asset_ref, r.tags or []))
    for uid, s in place.items():
        assert got.get(uid, []) == [(b["type"], b["content"], b["channel"], b["fixed"], b["pinned"], b["imp"], b["derivation"], b["asset"], b["tags"] or []) for b in s["blocks"]], uid
    assert {r.section_uid: r.title for r in after.sections.collect()} == {sec["uid"]: sec["title"] for k in want.values() for sec in k["sections"]}
    assert {r.asset_uid: r.caption for r in after.assets.collect()} == {a: c for k in want.values() for a, c in k["assets"].items()}
    assert {r.deck_uid: (r.total_seconds, r.density) for r in after.decks.collect()} == {d: (k["total"], k["density"]) for d, k in want.items()}


def plan_of(spark, patches):
    """Stage of each patch (id, staged, wild, places) of one deck, ids in log order."""
    p = spark.createDataFrame([("D", i, i, staged, wild) for i, staged, wild, _ in patches], "deck_uid string, patch_id long, seq long, staged boolean, wild boolean")
    t = spark.createDataFrame([("D", i, x) for i, *_, places in patches for x in places], "deck_uid string, patch_id long, place string")
    return {r.patch_id: r.stage for r in rp.stages(p, t).collect()}


def test_stages_are_the_longest_chains(spark):
    rnd = random.Random(2)
    patches = [(i, rnd.random() < 0.6, rnd.random() < 0.05, rnd.sample("abcdefgh", rnd.choice([1, 1, 2]))) for i in range(1, 60)]
    patches = [(i, staged or wild or len(places) > 1, wild, [] if wild else places) for i, staged, wild, places in patches]
    at, floor, want = {}, 0, {}
    for i, staged, wild, places in patches:
        level = max([floor, *(at.get(x, 0) for x in places)])
        if wild:
            level = max([floor, *at.values()]) + 1
            floor = level
        elif staged:
            level += 1
            at |= dict.fromkeys(places, level)
        want[i] = level
    assert plan_of(spark, patches) == want
    alone = [(i, True, False, [f"s{i % 20}"]) for i in range(1, 41)]  # forty patches on twenty slides: two stages
    assert max(plan_of(spark, alone).values()) == 2


def test_preview_and_difference_between_positions(spark):
    decks = {f"D{i}": full_deck(f"D{i}") for i in range(3)}
    log = [o for o in any_log(random.Random(8), decks, 5) if o["op"] in ("set_text", "set_channel", "set_title", "retime", "pin", "delete_block", "set_slide_role", "set_dwell", "set_importance")]
    log.append(dict.fromkeys(log[0]) | dict(deck_uid="D0", seq=10**5, op_no=1, patch_id=10**5, op="pin", target="nowhere", value="true"))
    cols = [c.split()[0] for c in FULL.split(", ")]
    ops = spark.createDataFrame([tuple(o[c] for c in cols) for o in log], FULL)
    shown, refused = rp.preview(tables(spark, decks), ops)
    nodes = {r.node for r in shown.collect()}
    assert nodes == {"deck", "slide", "block"} and refused.count() > 0
    early = {d: min(o["seq"] for o in log if o["deck_uid"] == d) for d in decks}
    cut = lambda at: spark.createDataFrame(list(at.items()), "deck_uid string, seq long")
    late = dict.fromkeys(decks, 10**6)
    got = sorted(tuple(r) for r in rp.total_diff(tables(spark, decks), ops, cut(early), cut(late)).collect())
    first, _ = folded(decks, [o for o in log if o["seq"] <= early[o["deck_uid"]]])
    last, _ = folded(decks, log)
    want = sorted(tuple(r) for r in rp.changes(tables(spark, first).whole(), tables(spark, last).whole()).collect())
    assert got == want and got


def test_a_table_is_written_only_where_it_changed(spark, monkeypatch):
    """structural edits write their tables themselves, and what a refused patch returns to is written only where it differs."""
    written = []
    here = lambda df: written.append(set(df.columns)) or cut_lineage(df)
    monkeypatch.setattr(rp, "cut_lineage", here)
    monkeypatch.setattr(rp, "cut_each", lambda tables: {k: here(t) for k, t in tables.items()}, raising=False)
    pages = spark.createDataFrame([("d", "s", "p1", 1.0, "one", "text", False, None, False), ("d", "s", "p2", 2.0, "two", "text", False, None, False)], SLIDES)
    blocks = spark.createDataFrame([("d", p, f"{p}.{n}", n, "bullet", f"{p} {n}", "slide", False, False, 500, "authored", [], None, None) for p in ("p1", "p2") for n in (1, 2)], BLOCKS)
    ops = spark.createDataFrame([("d", 1, 1, 1, "split_block", "p1.1", None, ["x", "y"]), ("d", 2, 1, 2, "split_block", "p2.1", None, ["z"])],
                                "deck_uid string, seq long, op_no int, patch_id long, op string, target string, value string, parts array<string>")
    after, refused = rp.apply_patches(rp.Decks(pages, blocks), ops)
    assert [r.patch_id for r in refused.collect()] == [2]
    assert sorted((r.slide_uid, r.block_no, r.content) for r in after.blocks.collect()) == [
        ("p1", 1, "x"), ("p1", 2, "y"), ("p1", 3, "p1 2"), ("p2", 1, "p2 1"), ("p2", 2, "p2 2")]
    assert sum("block_no" in w for w in written) == 2 and not any("slide_no" in w or "asset_uid" in w or "total_seconds" in w for w in written if "op" not in w)


def test_kinds_of_one_stage_write_every_block_once(spark, monkeypatch):
    """the kinds of edits work on their own slides, side by side, and what is valid is judged once."""
    written = []
    here = lambda df: written.append(cut_lineage(df)) or written[-1]
    monkeypatch.setattr(rp, "cut_lineage", here)
    monkeypatch.setattr(rp, "cut_each", lambda tables: {k: here(t) for k, t in tables.items()})
    pages = spark.createDataFrame([("d", "s", f"p{n}", float(n), f"page {n}", "text", False, None, False) for n in range(1, 6)], SLIDES)
    blocks = spark.createDataFrame([("d", f"p{p}", f"p{p}.{n}", n, "bullet", f"p{p} {n}", "slide", False, False, 500, "authored", [], None, None)
                                    for p in range(1, 6) for n in (1, 2)], BLOCKS)
    ops = spark.createDataFrame([("d", 1, 1, 1, "split_block", "p1.1", ["x", "y"], None, None), ("d", 2, 1, 2, "merge_blocks", "p2.1", None, ["p2.2"], None),
                                 ("d", 3, 1, 3, "move_block", "p3.1", None, None, "p4")],
                                "deck_uid string, seq long, op_no int, patch_id long, op string, target string, parts array<string>, others array<string>, to_slide string")
    after, refused = rp.apply_patches(rp.Decks(pages, blocks), ops.withColumn("value", F.lit(None).cast("string")))
    assert refused.count() == 0
    assert sorted((r.slide_uid, r.block_no, r.content) for r in after.blocks.collect()) == [
        ("p1", 1, "x"), ("p1", 2, "y"), ("p1", 3, "p1 2"), ("p2", 1, "p2 1; p2 2"), ("p3", 1, "p3 2"), ("p4", 1, "p4 1"), ("p4", 2, "p4 2"), ("p4", 3, "p3 1"),
        ("p5", 1, "p5 1"), ("p5", 2, "p5 2")]
    assert sum(w.count() for w in written if "block_no" in w.columns) == 10
