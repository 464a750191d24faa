import random
import re

import pytest
from pyspark.sql import functions as F

from briefloom.functions import claims as cl
from briefloom.functions import cues
from briefloom.functions import latex as lx
from briefloom.functions import lines as ln
from briefloom.functions import measure as ms
from briefloom.functions import text as tx


def one(spark, expr, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expr.alias("v")).head()
    return row.v


@pytest.mark.parametrize("text, units", [("", 0), ("使用Transformer架构", 5), ("we present, a method", 4), ("，。；", 0), ("a-b c", 2),
                                         ("提升7.5个百分点", 7), ("-- ** !!", 0)])
def test_units(spark, text, units):
    assert one(spark, tx.count_units("t"), t=text) == units


def test_units_of_english_leave_ideographs_out(spark):
    assert one(spark, tx.count_units("t", "en"), t="使用 the model 架构") == 2


def test_normalise_is_idempotent_and_cleans(spark):
    dirty = "e" + chr(0x301) + chr(0x200B) + "　　x\r\n\r\n\r\n\r\ny  \t z " + chr(0xAD) + "\n"
    clean = one(spark, tx.normalize_text("t"), t=dirty)
    assert clean == "é x\n\ny z"
    assert one(spark, tx.normalize_text("t"), t=clean) == clean


@pytest.mark.parametrize("text, limit, points", [
    ("结构一致性正则项的设计", 18, ["结构一致性正则项的设计"]),
    ("本项目拟解决的核心科学问题是如何构造不坍缩的表征空间", 8, ["本项目拟解决的核心科学问题是如何构造不坍缩的表征空间"]),
    ("第一句话很短。第二句话也短。", 6, ["第一句话很短。", "第二句话也短。"]),
    ("甲甲甲甲甲甲，乙乙乙乙乙乙，丙", 7, ["甲甲甲甲甲甲", "乙乙乙乙乙乙，丙"]),
])
def test_points(spark, text, limit, points):
    assert one(spark, tx.split_into_points("t", limit), t=text) == points


def test_head_and_tail(spark):
    assert one(spark, tx.head_and_tail("t", 18), t="短要点").asDict() == {"head": "短要点", "tail": ""}
    halves = "甲" * 22 + "，" + "乙" * 21
    got = one(spark, tx.head_and_tail("t", 21), t=halves)
    assert got.head == "甲" * 22 and got.tail == "乙" * 21


def test_row_limits_equal_fixed_limits(spark):
    rows = [("one two, three four. five six; seven", n) for n in range(1, 9)]
    df = spark.createDataFrame(rows, "t string, n int")
    by_row = [r.v for r in df.select(tx.shorten_to("t", F.col("n")).alias("v"), "n").orderBy("n").collect()]
    fixed = [one(spark, tx.shorten_to("t", n), t=rows[0][0]) for _, n in rows]
    assert by_row == fixed


def test_row_limits_cut_in_one_match(spark):
    """no fold measures every word; letters and digits among the silent marks start no unit."""
    r = random.Random(4)
    texts = ["".join(r.choice(["ab", "c", " ", "，", ". ", "、", "3,5", "字", "３", "々", "-", "\n", "é"]) for _ in range(r.randint(1, 14))) for _ in range(150)]
    df = spark.createDataFrame([(t, n) for t in texts for n in (0, 1, 2, 4)], "t string, n int")
    short = tx.shorten_to("t", F.col("n"))
    assert "aggregate(" not in df.select(short)._jdf.queryExecution().optimizedPlan().toString()
    upto = F.transform(F.sequence(F.lit(1), F.length("t")), lambda i: tx.count_units(F.substr("t", F.lit(1), i)))
    for x in df.select("t", "n", short.alias("v"), upto.alias("u")).collect():
        want = x.t
        for marks in (tx.SENTENCE_ENDS, "，,、", tx.SPACE_CHARS) if x.u[-1] > x.n else ():
            ends = [k for k in range(1, len(x.t) + 1) if x.t[k - 1] in marks and x.u[k - 1] <= x.n]
            if ends and (cut := x.t[:ends[-1]].strip().rstrip(tx.TRAILING_MARKS + "\u3000 ")):
                want = cut
                break
        assert x.v == want, (x.t, x.n)


def test_opening_claim_starts_at_the_connective(spark):
    assert one(spark, tx.opening_claim("t"), t="深度学习取得了成功，但在小样本场景下表现不佳。") == "但在小样本场景下表现不佳。"


def test_titles_and_notes(spark):
    assert one(spark, tx.tidy_title("t"), t="2.1 方法") == "方法"
    assert one(spark, tx.tidy_title("t"), t="3.") == "内容"
    assert one(spark, tx.continued_title("t"), t="方法（续）") == "方法（续）"
    assert one(spark, tx.caption_title("t", F.lit("f")), t="图3：网络结构") == "网络结构"


@pytest.mark.parametrize("title, key", [("研究基础", "prior_work"), ("特色与创新", "innovation"), ("技术路线", "methods"),
                                        ("经费预算", "budget"), ("Related Work", "prior_work"), ("其他", None)])
def test_rubrics(spark, title, key):
    assert one(spark, cl.classify_by_keywords("t"), t=title) == key


def test_score(spark):
    def score(kind, text):
        return one(spark, cl.score_segment(F.col("k"), F.col("t"), F.lit("methods")), k=kind, t=text)

    assert score("list_item", "精度提升7.5个百分点，参数量降低54%") == 720
    assert score("paragraph", "短") == 370


def test_spacing_repair(spark):
    assert one(spark, ln.collapse_spaced_runs("t"), t="C h e n T, e t a l") == "ChenT, etal"
    assert one(spark, ln.collapse_spaced_runs("t"), t="it is a test of it") == "it is a test of it"


def test_a_long_run_of_fragments_does_not_overflow(spark):
    """a run is matched in a loop, whatever its length."""
    assert one(spark, ln.collapse_spaced_runs("t"), t="see, " + "x " * 20000 + "words") == "see, " + "x" * 20000 + "words"
    assert one(spark, ln.collapse_spaced_runs("t"), t="ab " * 20000 + ",") == "ab " * 20000 + ","


def test_inline_items(spark):
    assert one(spark, ln.split_inline_items("t"), t="(1) 甲 (2) 乙") == ["(1) 甲", "(2) 乙"]
    assert one(spark, ln.split_inline_items("t"), t="参见 (1) 与 (2)") == ["参见 (1) 与 (2)"]


def test_join_lines(spark):
    df = spark.createDataFrame([(["deep learn-", "ing works", "很好", "的"],)], "p array<string>")
    assert df.select(ln.join_lines(F.col("p")).alias("v")).head().v == "deep learning works很好的"


def test_latex(spark):
    assert one(spark, lx.strip_latex("t"), t=r"A \textbf{b} $x_1$\cite{k} 5\%") == "A b $x_1$ 5%"
    assert one(spark, lx.escape_latex("t"), t="a\\b & {c}") == r"a\textbackslash{}b \& \{c\}"
    assert one(spark, lx.equation_problem("t"), t=r"\begin{align}x") == "environments"
    assert one(spark, lx.equation_problem("t"), t=r"\Input{x} $") == r"forbidden \input"
    # A formula inside a dropped argument goes with it, and nested drops do not save the note around them.
    assert one(spark, lx.strip_latex("t"), t=r"$a$ x\footnote{n $x_{2}$ \label{q} b} y $b$") == "$a$ x y $b$"
    assert one(spark, lx.strip_math("t"), t=r"\[\sqrt{\frac{a}{b}}^{2} \alpha\]") == "sqrt((a)/(b))2"
    assert one(spark, lx.strip_math("t"), t=r"$\frac{a}{b} \le c$") == "(a)/(b) <= c"


@pytest.mark.parametrize("text, n, secs", [("后两条", 2, None), ("最后三个点", 3, None), ("压到8分钟", None, 480), ("多给30秒", None, 30),
                                           ("十分钟", None, 600), ("12 minutes", None, 720)])
def test_cues(spark, text, n, secs):
    assert one(spark, cues.count_phrase("t"), t=text) == n
    assert one(spark, cues.duration_seconds("t"), t=text) == secs


def plain_lines(text, width, size, em):
    """Lines by the rules as they are told: a list of (kind, word), and the line that is open."""
    words = re.findall(r"[A-Za-z0-9][A-Za-z0-9\-'./]*|[^\S\u3000]+|(?s:.)", text)
    length = lambda s: sum(em(ch) for ch in s)
    room, done, line, used = int(round(width / size * ms.EM, 3) // 1), [], "", 0
    for word in words:
        w = length(word)
        fits = used + w <= room
        if word.isspace() and not (line and fits):
            if line:
                done.append(line)
            line, used = "", 0
        elif line and not fits and word[0] in ms.CLOSING:
            done.append(line + word)
            line, used = "", 0
        else:
            if line and not fits:
                kept = line.rstrip(ms.OPENING)
                done.append(kept)
                word, line, used = line[len(kept):] + word, "", 0
            if w <= room:
                line, used = line + word, used + w
                continue
            for ch in word:
                if line and used + em(ch) > room:
                    done.append(line)
                    line, used = "", 0
                line, used = line + ch, used + em(ch)
    done += [line] if line else []
    return done or [""]


def class_em(ch):
    return ms.WIDE_EM if ms.is_wide(ch) else ms.SPACE_EM if ch == " " else ms.DIGIT_EM if ch.isdigit() else ms.LETTER_EM


def test_wrapping_rules():
    assert plain_lines("alpha beta gamma", 60.0, 10.0, class_em) == ["alpha beta ", "gamma"]
    assert plain_lines("研究方法，实验结果", 40.0, 10.0, class_em) == ["研究方法，", "实验结果"]  # a closing mark never starts a line


def test_wrapping_against_a_plain_rendering(spark):
    rnd = random.Random(3)
    signs = "aaabcdefgh  ,.;()[]（【“，。！研究方法与12-'/\t３é\u3000"
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(0, 60))) for _ in range(150)]
    texts += ["", "   ", "((((aaaaaaaaaaaaaaaaa", "（（（研究", "a" * 300, "甲" * 40 + "，，，，", "word " * 400]
    rows = [(t, w, z) for t in texts for w, z in ((60.0, 10.0), (33.3, 12.0), (5.0, 10.0), (200.0, 14.0))]
    given = {"a": 0.31, "研": 0.9, " ": 0.0}
    df = spark.createDataFrame(rows, "t string, w double, z double")
    advances = F.create_map(*[F.lit(x) for kv in given.items() for x in kv])
    got = df.select("*", ms.wrap_lines("t", F.col("w"), F.col("z")).alias("a"), ms.wrap_lines("t", F.col("w"), F.col("z"), advances).alias("b")).collect()
    for r in got:
        for em, made in ((class_em, r.a), (lambda ch: round(given.get(ch, 0) * ms.EM) or class_em(ch), r.b)):
            lines = plain_lines(r.t, r.w, r.z, em)
            assert made.lines == len(lines)
            assert made.widest == pytest.approx(max(sum(map(em, x)) for x in lines) / ms.EM * r.z)
    none = spark.createDataFrame([(None, 10.0), ("x y", 0.0)], "t string, w double").select(ms.wrap_lines("t", F.col("w"), F.lit(10)).alias("m")).collect()
    assert [r.m.lines for r in none] == [1, 1]


@pytest.mark.parametrize("lang", ["zh", "en"])
def test_capacity_is_the_longest_sample_that_fits(spark, lang):
    boxes = [(w, h, z) for w, h in ((300, 100), (600, 250), (150, 40), (80, 300), (20, 100), (0, 50), (50, 0)) for z in (12, 20)]
    df = spark.createDataFrame([(float(w), float(h), float(z), lang) for w, h, z in boxes], "w double, h double, z double, l string")
    got = df.withColumn("n", ms.capacity_units(F.col("w"), F.col("h"), F.col("z"), F.col("l"))).collect()
    spacing = ms.CJK_SPACING if lang == "zh" else ms.LATIN_SPACING

    def fits(n, r):
        words = ms.FILLER_EN.split()
        text = " ".join((words * (n // len(words) + 1))[:n]) if lang == "en" else (ms.FILLER_ZH * (n // len(ms.FILLER_ZH) + 1))[:n]
        return len(plain_lines(text, r.w, r.z, class_em)) <= r.h // (r.z * spacing)

    for r in got:
        assert r.n == 0 or fits(r.n, r)
        mean = sum(map(class_em, ms.MEAN_SAMPLES[lang])) / len(ms.MEAN_SAMPLES[lang]) / ms.EM
        most = int(r.h // (r.z * spacing) * (r.w / (mean * r.z)) / (ms.MEAN_WORD if lang == "en" else 1))
        assert r.n >= most or not fits(r.n + 1, r)
    assert any(r.n > 0 for r in got)


def test_widths_in_two_fonts(spark):
    texts = spark.createDataFrame([(1, "aab 研"), (2, ""), (None, "b")], "k int, t string")
    fonts = spark.createDataFrame([("s", "a", 0.3), ("s", "b", 0.0), ("m", "a", 0.6), ("m", "b", 0.6)], "font string, ch string, em double")
    got = {(r.k, r.font): round(r.em, 6) for r in ms.measured_widths(texts, ["k"], "t", fonts).collect()}
    assert got == {(1, "s"): 2.38, (1, "m"): 3.06, (2, "s"): 0.0, (2, "m"): 0.0, (None, "s"): 0.52, (None, "m"): 0.6}


def test_table_function_equals_the_expression(spark):
    from briefloom.functions import udtf

    udtf.register(spark)
    texts = ["one two, three four. five six; seven", "甲甲甲甲甲甲，乙乙乙乙乙乙，丙", "", "short"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").createOrReplaceTempView("txt")
    sql = spark.sql("SELECT i, point_no, point FROM txt, LATERAL points(t, 5)").collect()
    cols = spark.table("txt").select("i", F.posexplode(tx.split_into_points("t", 5)).alias("p", "point")).collect()
    assert sorted((r.i, r.point_no, r.point) for r in sql) == sorted((r.i, r.p + 1, r.point) for r in cols)


def test_a_word_without_end_is_measured_in_one_pass(spark):
    import time

    from pyspark.sql import functions as F

    from briefloom.functions import text as tx

    word = "a" * 60_000
    df = spark.createDataFrame([(f"{word}!，one two, {word}-; three four five six",), (f"{word}...",)], "t string")
    began = time.time()
    got = [[(g.u, g.h, g.t) for g in r.g] for r in df.select(tx._gauge(tx.clauses("t")).alias("g")).collect()]
    assert got == [[(1, True, False), (2, True, True), (1, False, True), (4, False, True)], [(1, True, True)]]
    assert df.select(F.size(tx.split_into_points("t", 3)).alias("n")).collect()[0].n >= 3
    assert time.time() - began < 30
