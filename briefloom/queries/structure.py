"""Structure queries: lines, paragraphs, captions, tables, typeset sources, escaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from briefloom.functions import latex as lx
from briefloom.functions import lines as ln
from briefloom.functions import text as tx
from briefloom.operators import structure as st
from briefloom.queries import base as b
from briefloom.queries.registry import query
from briefloom.sources import corpus as c


def doc_lines(spark, sf):
    """Sentences as extracted lines with page, size, weight and position; some turned into list marks or captions."""
    lists = F.flatten(F.transform(F.split("text", "\n"), tx.sentences))
    d = c.documents(spark, sf).select("doc_id", F.posexplode(lists).alias("p", "s"))
    no, n = F.col("p") + 1, F.length("s")
    head = F.when(no % 13 == 0, "(1) ").when(no % 17 == 0, "Figure 2: ").when(no % 19 == 0, "3.1 ").otherwise("")
    return d.select("doc_id", no.cast("long").alias("line_no"), (1 + F.floor(F.col("p") / 40)).cast("long").alias("page"),
                    F.concat(head, "s").alias("text"), (F.lit(10.0) + n % 3).alias("size"), (n < 30).alias("bold"),
                    F.when(no % 2 == 0, F.lit(350.0)).otherwise(F.lit(50.0)).alias("x"),
                    (F.lit(12.0) * no).alias("y"))


DOCLINES = b.SENTS + """,
dl AS (
  SELECT doc_id, no AS line_no, 1 + (no - 1) // 40 AS page,
         CASE WHEN no % 13 = 0 THEN '(1) ' WHEN no % 17 = 0 THEN 'Figure 2: ' WHEN no % 19 = 0 THEN '3.1 ' ELSE '' END
           || content AS text, 10.0::DOUBLE + len(content) % 3 AS size, len(content) < 30 AS bold,
         CASE WHEN no % 2 = 0 THEN 350.0 ELSE 50.0 END AS x, 12.0 * no AS y
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY slide_no, block_no) AS no FROM sents)),
body AS (SELECT doc_id, arg_max(size, n * 1000000000 - f) AS body FROM
  (SELECT doc_id, size, count(*) AS n, min(line_no) AS f FROM dl GROUP BY ALL) GROUP BY doc_id)"""
HEAD = r"""lv AS (
  SELECT *, CASE WHEN len(text) > 120 THEN 0
    WHEN regexp_matches(text, '^[0-9]+([.][0-9]+)* *[.、]? +[^ ]') AND (size / body >= 1.02 OR bold)
      THEN least(len(string_split(regexp_extract(text, '^[0-9.]*[0-9]'), '.')), 4)
    WHEN size / body >= 1.5 THEN 1 WHEN size / body >= 1.22 THEN 2
    WHEN size / body >= 1.08 AND bold AND len(text) < 60 THEN 3
    WHEN bold AND len(text) <= 20 AND size / body >= 0.98 AND NOT regexp_matches(text, '[。.，]$') THEN 2 ELSE 0 END AS lvl
  FROM dl JOIN body USING (doc_id))"""
ITEM = r"regexp_matches({x}, '^ *(?:[-•·▪◦]|[（(] *(?:[0-9]+|[一二三四五六七八九十]+) *[)）]|[0-9]+ *[.)、]) *')"
CAP = r"regexp_matches({x}, '(?i)^ *(figure|fig\.?|table|tab\.?|图|表) *[0-9一二三四五六七八九十]+')"


@query("body_size", b.with_(DOCLINES, body="SELECT doc_id, body FROM body"))
def body_size(spark, sf):
    return st.body_size(doc_lines(spark, sf))


@query("heading_levels", b.with_(DOCLINES, HEAD, body="SELECT doc_id, line_no, CAST(lvl AS INTEGER) AS heading_level FROM lv"))
def heading_levels(spark, sf):
    return st.line_kinds(doc_lines(spark, sf)).select("doc_id", "line_no", "heading_level")


PARS = f"""fl AS (
  SELECT *, coalesce(lag(lvl > 0 OR (regexp_matches(text, '[.!?]$') AND len(text) < 60) OR regexp_matches(text, '[。！？；]$'))
           OVER (PARTITION BY doc_id ORDER BY line_no), true)
         OR lvl > 0 OR {ITEM.format(x='text')} OR {CAP.format(x='text')} AS fresh FROM lv),
pn AS (SELECT *, CAST(sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS par_no FROM fl)"""


@query("paragraphs_joined", b.with_(DOCLINES, HEAD, PARS, body=f"""
SELECT doc_id, par_no, min(page) AS page, CAST(max(lvl) AS INTEGER) AS heading_level,
       {b.strip("string_agg(text, ' ' ORDER BY line_no)")} AS text FROM pn GROUP BY doc_id, par_no"""))
def paragraphs_joined(spark, sf):
    return st.paragraphs(st.lines_to_paragraphs(st.line_kinds(doc_lines(spark, sf))))


@query("block_kinds", b.with_(DOCLINES, r"""
t AS (SELECT doc_id, line_no, CASE line_no % 6 WHEN 0 THEN 'a=' || substr(text, 1, 2) || '+1 × 2' WHEN 1 THEN '- ' || text
        WHEN 2 THEN 'Table 3 ' || text ELSE text END AS text FROM dl)""", body=f"""
SELECT doc_id, line_no, CASE WHEN {CAP.format(x='text')} AND len(text) < 300 THEN 'caption'
  WHEN {ITEM.format(x='text')} THEN 'list_item'
  WHEN len(text) < 200 AND regexp_matches(text, '[=≈≤≥∑∫∂√±×÷∞]')
    AND len(regexp_extract_all(text, '\\p{{L}}')) * 20 < len(text) * 11 THEN 'equation' ELSE 'paragraph' END AS kind
FROM t"""))
def block_kinds(spark, sf):
    n = F.col("line_no") % 6
    t = doc_lines(spark, sf).withColumn("text", F.when(n == 0, F.concat(F.lit("a="), F.substring("text", 1, 2), F.lit("+1 × 2")))
                                        .when(n == 1, F.concat(F.lit("- "), "text"))
                                        .when(n == 2, F.concat(F.lit("Table 3 "), "text")).otherwise(F.col("text")))
    return t.select("doc_id", "line_no", ln.classify_block("text").alias("kind"))


@query("inline_items", b.with_(DOCLINES, r"""
t AS (SELECT doc_id, line_no, CASE WHEN line_no % 3 = 0 THEN '(1) ' || text || ' (2) ' || substr(text, 1, 9) || '（三） x'
        WHEN line_no % 3 = 1 THEN 'see (1) and (2) ' || text ELSE text END AS text FROM dl WHERE NOT regexp_matches(text, '[0-9] *[.、]( |$)')),
cut AS (SELECT *, string_split(regexp_replace(text, '([（(] *(?:[0-9]+|[一二三四五六七八九十]+) *[)）] *)', chr(1) || '\1', 'g'), chr(1)) AS p
        FROM t)""", body=f"""
SELECT doc_id, line_no, unnest(CASE WHEN len(p) >= 3 AND len(p[1]) <= 2
  THEN list_filter(list_transform(p[2:], lambda x: {b.strip('x')}), lambda x: x <> '') ELSE [text] END) AS item FROM cut"""))
def inline_items(spark, sf):
    d = doc_lines(spark, sf).filter(
        ~F.col("text").rlike("[0-9] *[.、]( |$)"))
    n = F.col("line_no") % 3
    text = (F.when(n == 0, F.concat(F.lit("(1) "), "text", F.lit(" (2) "), F.substring("text", 1, 9), F.lit("（三） x")))
            .when(n == 1, F.concat(F.lit("see (1) and (2) "), "text")).otherwise(F.col("text")))
    return d.select("doc_id", "line_no", F.explode(ln.split_inline_items(text)).alias("item"))


_WORDS = "[" + ", ".join(f"'{w}'" for w in ln.SHORT_WORDS) + "]"


@query("spacing_repair", b.with_(DOCLINES, r"""
t AS (SELECT doc_id, line_no, CASE WHEN line_no % 2 = 0 THEN trim(regexp_replace(substr(text, 1, 14), '(.)', '\1 ', 'g')) || '; ' || text
        ELSE text || ' the of a to in is by' END AS text FROM dl),
r AS (SELECT *, regexp_extract_all(text, '(?:[A-Za-z0-9]{1,3}[ ]){3,}[A-Za-z0-9]{1,3}') AS runs,
             regexp_split_to_array(text, '(?:[A-Za-z0-9]{1,3}[ ]){3,}[A-Za-z0-9]{1,3}') AS pieces FROM t),
k AS (SELECT *, list_transform(runs, lambda r: CASE
        WHEN (len(r) - len(string_split(r, ' ')) + 1) * 5 > len(string_split(r, ' ')) * 8
          OR (len(list_filter(string_split(r, ' '), lambda w: list_contains(""" + _WORDS + r""", lower(w)))) >= 2
              AND len(list_filter(string_split(r, ' '), lambda w: list_contains(""" + _WORDS + r""", lower(w)))) * 2
                  >= len(string_split(r, ' '))) THEN r ELSE replace(r, ' ', '') END) AS fixed FROM r)""", body="""
SELECT doc_id, line_no, array_to_string(list_transform(range(1, len(pieces) + 1),
   lambda i: coalesce(pieces[i], '') || coalesce(fixed[i], '')), '') AS text FROM k"""))
def spacing_repair(spark, sf):
    d = doc_lines(spark, sf)
    wide = F.btrim(tx.sub(F.substring("text", 1, 14), "(.)", "$1 "))
    text = F.when(F.col("line_no") % 2 == 0, F.concat(wide, F.lit("; "), "text")).otherwise(
        F.concat("text", F.lit(" the of a to in is by")))
    return d.select("doc_id", "line_no", ln.collapse_spaced_runs(text).alias("text"))


@query("residual_spacing", b.with_(DOCLINES, r"""
t AS (SELECT doc_id, CASE WHEN line_no % 5 = 0 THEN trim(regexp_replace(text, '(.)', '\1 ', 'g')) ELSE text END AS text FROM dl),
k AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS tk FROM t)""", body="""
SELECT doc_id, count(*) FILTER (len(tk) >= 6 AND len(list_filter(tk, lambda x: regexp_matches(x, '^[A-Za-z]$'))) * 2 >= len(tk))
  AS residual FROM k GROUP BY doc_id"""))
def residual_spacing(spark, sf):
    d = doc_lines(spark, sf)
    wide = F.btrim(tx.sub(F.col("text"), "(.)", "$1 "))
    return st.residual_spacing(d.withColumn("text", F.when(F.col("line_no") % 5 == 0, wide).otherwise(F.col("text"))))


@query("ligatures_repaired", """
SELECT doc_id, replace(replace(text, 'ti', 'fi'), 'ff', 'ff') AS text FROM documents""")
def ligatures_repaired(spark, sf):
    dirty = F.replace(F.col("text"), F.lit("ti"), F.lit(chr(0xFB01)))
    dirty = F.replace(dirty, F.lit("ff"), F.lit(chr(0xFB00)))
    return c.documents(spark, sf).select("doc_id", ln.repair_ligatures(dirty).alias("text"))


@query("words_by_gap", b.with_(b.LINES, r"""
w AS (SELECT doc_id, slide_no, list_filter(string_split(line, ' '), lambda x: x <> '') AS ws FROM lines),
j AS (SELECT doc_id, slide_no, array_to_string(list_transform(range(1, len(ws) + 1), lambda i:
        CASE WHEN i > 1 AND (i - 1) * 7 % 5 > 2 THEN ' ' ELSE '' END || ws[i]), '') AS t FROM w)""", body=r"""
SELECT doc_id, slide_no, t AS text FROM j WHERE NOT regexp_matches(t, '(?:[A-Za-z0-9]{1,3}[ ]){3,}[A-Za-z0-9]{1,3}')"""))
def words_by_gap(spark, sf):
    words = F.filter(F.split("line", " "), lambda w: w != "")
    # Word i starts at 50 i; the gap before it follows from where the word before ends.
    parts = F.transform(words, lambda w, i: F.struct(
        w.alias("text"), (i * 50).cast("double").alias("x0"), ((i + 1) * 50 - (i + 1) * 7 % 5).cast("double").alias("x1"),
        F.lit(10.0).alias("size")))
    out = st.join_words_by_gap(c.lines(spark, sf).select("doc_id", "slide_no", parts.alias("parts")))
    glued = F.array_join(F.transform(words, lambda w, i: F.concat(F.when((i > 0) & (i * 7 % 5 > 2), " ").otherwise(""), w)), "")
    plain = c.lines(spark, sf).filter(~glued.rlike(ln.SPACED_RUN)).select("doc_id", "slide_no")
    return out.join(plain, ["doc_id", "slide_no"], "left_semi")


@query("reading_order", b.with_(DOCLINES, """
bl AS (SELECT doc_id, page, line_no, CASE WHEN doc_id % 2 = 0 THEN x ELSE 50.0 END AS x, y FROM dl),
cnt AS (SELECT doc_id, page, count(*) FILTER (x < 270) AS l, count(*) FILTER (x >= 270) AS r FROM bl GROUP BY ALL)""", body="""
SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id, page
  ORDER BY CASE WHEN l >= 2 AND r >= 2 AND x >= 270 THEN 1 ELSE 0 END, y, line_no) AS order_no
FROM bl JOIN cnt USING (doc_id, page)"""))
def reading_order(spark, sf):
    d = doc_lines(spark, sf).select(
        "doc_id", "page", F.col("line_no").alias("block_no"), F.lit(600.0).alias("page_w"), "y",
        F.when(F.col("doc_id") % 2 == 0, F.col("x")).otherwise(50.0).alias("x"))
    return st.reading_order(d).select("doc_id", F.col("block_no").alias("line_no"), "order_no")


EVENTS_SQL = """ev AS (
  SELECT doc_id, slide_no AS pos, slide_no % 4 IN (1, 2) AS is_caption,
         CASE WHEN (slide_no + doc_id) % 3 = 0 THEN 'table' ELSE 'figure' END AS kind,
         1 + slide_no // 5 AS page, 'a' || slide_no AS id FROM lines)"""


@query("caption_nearest", b.with_(b.LINES, EVENTS_SQL, """
walk AS (
  SELECT doc_id, 0::BIGINT AS pos, []::STRUCT(kind VARCHAR, page BIGINT, id VARCHAR)[] AS open, NULL::VARCHAR AS claim,
         false AS is_caption FROM documents
  UNION ALL
  SELECT doc_id, pos, CASE WHEN is_caption THEN list_filter(open, lambda a: won IS NULL OR a.id <> won)
                           ELSE list_append(open, {'kind': kind, 'page': page, 'id': id}) END, won, is_caption
  FROM (SELECT e.*, w.open, CASE WHEN e.is_caption THEN
          list_filter(w.open, lambda a: a.kind = e.kind AND abs(a.page - e.page) <= 1)[-1].id END AS won
        FROM walk w JOIN ev e ON e.doc_id = w.doc_id AND e.pos = w.pos + 1))""", recursive=True, body="""
SELECT doc_id, pos, claim AS asset_id FROM walk WHERE is_caption"""))
def caption_nearest(spark, sf):
    i = F.col("doc_id")
    items = F.transform(F.split("text", "\n"), lambda t, p: F.struct(
        (p + 1).cast("long").alias("pos"), ((p + 1) % 4).isin(1, 2).alias("is_caption"),
        F.when((p + 1 + i) % 3 == 0, "table").otherwise("figure").alias("kind"),
        (1 + F.floor((p + 1) / 5)).cast("int").alias("page"), F.concat(F.lit("a"), p + 1).alias("id")))
    return st.bind_captions_nearest(c.documents(spark, sf).select("doc_id", items.alias("items")))


@query("caption_adjacent", b.with_(b.LINES, """
sg AS (SELECT doc_id, slide_no, CASE slide_no % 4 WHEN 1 THEN 'asset' WHEN 2 THEN 'caption' WHEN 0 THEN 'caption' ELSE 'other' END AS kind,
              CASE WHEN (slide_no // 4 + doc_id) % 2 = 0 THEN 'table' ELSE 'figure' END AS label, 'a' || slide_no AS id FROM lines),
walk AS (
  SELECT doc_id, 0::BIGINT AS pos, NULL::VARCHAR AS aid, NULL::VARCHAR AS alabel, true AS acap, NULL::BIGINT AS pend,
         NULL::BIGINT AS cap_pos, NULL::VARCHAR AS bound FROM documents
  UNION ALL
  SELECT s.doc_id, s.slide_no, CASE WHEN kind = 'asset' THEN id ELSE aid END,
         CASE WHEN kind = 'asset' THEN label ELSE alabel END,
         CASE WHEN kind = 'asset' THEN pend IS NOT NULL AND label = 'table'
              WHEN kind = 'caption' THEN acap OR label = alabel ELSE acap END,
         CASE WHEN kind = 'caption' AND NOT (NOT acap AND label = alabel) THEN s.slide_no END,
         CASE WHEN kind = 'caption' AND NOT acap AND label = alabel THEN s.slide_no
              WHEN kind = 'asset' AND label = 'table' AND pend IS NOT NULL THEN pend END,
         CASE WHEN kind = 'caption' AND NOT acap AND label = alabel THEN aid
              WHEN kind = 'asset' AND label = 'table' AND pend IS NOT NULL THEN id END
  FROM walk w JOIN sg s ON s.doc_id = w.doc_id AND s.slide_no = w.pos + 1)""", recursive=True, body="""
SELECT doc_id, cap_pos AS seg_no, bound FROM walk WHERE bound IS NOT NULL"""))
def caption_adjacent(spark, sf):
    i = F.col("doc_id")
    items = F.transform(F.split("text", "\n"), lambda t, p: F.struct(
        (p + 1).cast("long").alias("pos"), F.when((p + 1) % 4 == 1, "asset").when((p + 1) % 2 == 0, "caption")
        .otherwise("other").alias("kind"), F.when((F.floor((p + 1) / 4) + i) % 2 == 0, "table").otherwise("figure")
        .alias("label"), F.concat(F.lit("a"), p + 1).alias("id")))
    return st.bind_captions_adjacent(c.documents(spark, sf).select("doc_id", items.alias("items")))


@query("table_cells", """
WITH t AS (SELECT p_partkey AS asset_id, ['name', 'size', 'price'] AS h,
                  [p_name, CAST(p_size AS VARCHAR)] AS r1, [p_brand, '7', '8%'] AS r2 FROM part)
SELECT asset_id, rn AS row_no, cn - 1 AS col_no, coalesce(CASE rn WHEN 0 THEN h[cn] WHEN 1 THEN r1[cn] ELSE r2[cn] END, '') AS cell
FROM t, (SELECT unnest([0, 1, 2]) AS rn), (SELECT unnest([1, 2, 3]) AS cn)""")
def table_cells(spark, sf):
    t = c.read(spark, sf, "part").select(
        F.col("p_partkey").alias("asset_id"), F.array(F.lit("name"), F.lit("size"), F.lit("price")).alias("columns"),
        F.array(F.array("p_name", F.col("p_size").cast("string")), F.array("p_brand", F.lit("7"), F.lit("8%"))).alias("rows"))
    return st.explode_tables(t)


@query("table_headers", """
SELECT p_partkey, (p_partkey % 3 <> 0) AND NOT regexp_matches(CASE WHEN p_partkey % 4 = 0 THEN '12' ELSE p_name END, '^[-+]?[0-9.,]+%?$') AS is_header,
       NOT regexp_matches(CASE WHEN p_partkey % 4 = 0 THEN '12' ELSE p_name END, '^[-+]?[0-9.,]+%?$') AS latex_header FROM part""")
def table_headers(spark, sf):
    head = F.array(F.when(F.col("p_partkey") % 4 == 0, "12").otherwise(F.col("p_name")), F.lit("size"))
    body = F.array(F.when(F.col("p_partkey") % 3 == 0, "n/a").otherwise(F.col("p_size").cast("string")), F.col("p_brand"))
    t = c.read(spark, sf, "part").select("p_partkey", F.array(head, body).alias("rows"))
    return t.select("p_partkey", ln.looks_like_header(F.col("rows")).alias("is_header"),
                    ln.latex_header(F.col("rows")).alias("latex_header"))


# ------------------------------------------------------------- typeset sources

_W = r"regexp_replace(line, '[^\p{L}]', '', 'g')"
# Every line of every document, under a key of its own, with all its letters.
KEYED = b.LINES + f", d AS (SELECT doc_id || '.' || slide_no AS doc_id, {_W} AS w FROM lines)"


def keyed_lines(spark, sf):
    return c.lines(spark, sf).select(F.concat_ws(".", "doc_id", "slide_no").alias("doc_id"), tx.sub(F.col("line"), r"[^\p{L}]", "").alias("w"))


@query("latex_stripped", f"""
WITH d AS (SELECT doc_id, {b.strip(f"""regexp_replace(regexp_replace(text, '[{{}}$~&#_%^]|[{chr(92) * 2}]', '', 'g'), '{b.SPACE}+', ' ', 'g')""")} AS w FROM documents)
SELECT doc_id, rtrim('Some bold text, $x_{{1}}$ and 5% more by ' || w) AS plain FROM d""")
def latex_stripped(spark, sf):
    w = tx.sub(F.col("text"), r"[{}$~&#_%^\\]", "")
    src = F.concat(F.lit(r"Some \textbf{bold} text\cite[p.~2]{k1}, $x_{1}$ and~5\% more \label{q} by {\small "), w, F.lit("}"))
    return c.documents(spark, sf).select("doc_id", lx.strip_latex(src).alias("plain"))


@query("latex_blocks", b.with_(KEYED, body="""
SELECT doc_id, 'heading' AS class, 1 AS level, 'Part ' || doc_id AS text FROM d
UNION ALL SELECT doc_id, 'text', 0, 'Some bold text, $x_{1}$ and 5% more.' FROM d
UNION ALL SELECT doc_id, 'list', 0, '\\item one \\begin{enumerate}\\item deep\\end{enumerate} \\item two' FROM d
UNION ALL SELECT doc_id, 'text', 0, 'tail' FROM d
UNION ALL SELECT doc_id, 'equation', 0, 'a=b_' || doc_id FROM d
UNION ALL SELECT doc_id, 'heading', 2, 'Sub' FROM d
UNION ALL SELECT doc_id, 'text', 0, w FROM d WHERE w <> ''"""))
def latex_blocks(spark, sf):
    src = F.concat(F.lit(r"\section{Part "), "doc_id", F.lit(r"}\label{sec:a} Some \textbf{bold} text\cite{k1}, $x_{1}$ and ~ 5\% more. "),
                   F.lit(r"\begin{itemize}\item one \begin{enumerate}\item deep\end{enumerate} \item two\end{itemize} tail "),
                   F.lit(r"\begin{equation}a=b_"), "doc_id", F.lit(r"\end{equation}\subsection*{Sub}"), "w")
    return st.latex_blocks(keyed_lines(spark, sf).select("doc_id", src.alias("text"))).select("doc_id", "class", "level", "text")


@query("list_levels", b.with_(KEYED, body="""
SELECT doc_id, 0 AS level, rtrim('one ' || w) AS text FROM d UNION ALL SELECT doc_id, 1, 'deep' FROM d UNION ALL SELECT doc_id, 0, 'two' FROM d"""))
def list_levels(spark, sf):
    src = F.concat(F.lit(r"\begin{itemize}\item[x] one "), "w", F.lit(r" \begin{enumerate}\item deep\end{enumerate} \item two\end{itemize}"))
    return st.list_levels(keyed_lines(spark, sf).select("doc_id", src.alias("text"))).select("doc_id", "level", "text")


@query("tabular_cells", b.with_(KEYED, body="""
SELECT doc_id, r - 1 AS row_no, ['Name|Size', w || '|5%'][r] AS cells FROM d, range(1, 3) x(r)"""))
def tabular_cells(spark, sf):
    src = F.concat(F.lit("\\begin{table}\\begin{tabular}{ll}\\toprule Name & \\textbf{Size} \\\\ \\hline "), "w",
                   F.lit(" & 5\\% \\\\ \\bottomrule\\end{tabular}\\end{table}"))
    return keyed_lines(spark, sf).select("doc_id", F.posexplode(lx.tabular_cells(src)).alias("row_no", "r")).select(
        "doc_id", F.col("row_no").cast("long").alias("row_no"), F.array_join("r", "|").alias("cells"))


# Files of the documents' whole texts, in chains of nine that each include the next; every third chain ends in a loop of three.
_NEXT = "CASE WHEN doc_id % 27 = 26 THEN doc_id - 2 WHEN doc_id % 9 < 8 THEN doc_id + 1 END"
FILES = f"""own AS (SELECT doc_id, regexp_replace(text, '[{chr(92) * 2}{{}}]', '', 'g') AS w, {_NEXT} AS nxt FROM documents),
linked AS (SELECT o.*, n.doc_id AS there, doc_id % 27 >= 18 AND (SELECT max(doc_id) FROM own) >= doc_id // 27 * 27 + 26 AS looped
           FROM own o LEFT JOIN (SELECT doc_id FROM own) n(doc_id) ON n.doc_id = nxt)""".replace("o.*, n.doc_id AS there, doc_id % 27", "o.*, n.doc_id AS there, o.doc_id % 27").replace(
               ">= doc_id // 27", ">= o.doc_id // 27")


def include_files(spark, sf):
    k = F.col("doc_id")
    nxt = F.when(k % 27 == 26, k - 2).when(k % 9 < 8, k + 1)
    text = F.concat(tx.sub(F.col("text"), r"[\\{}]", ""), F.lit(r"\include{nowhere}; "), F.coalesce(F.concat(F.lit(r"\input{ d"), nxt, F.lit("}")), F.lit("end")))
    return c.documents(spark, sf).select(F.concat(F.lit("d"), k, F.lit(".tex")).alias("path"), text.alias("text"))


@query("includes_expanded", b.with_(FILES, body="""
SELECT 'd' || a.doc_id || '.tex' AS path, CASE WHEN a.looped THEN a.w || '; ' || chr(92) || 'input{ d' || a.nxt || '}'
         ELSE string_agg(b.w || '; ' || CASE WHEN b.nxt IS NULL THEN 'end' ELSE '' END, '' ORDER BY b.doc_id) END AS text
FROM linked a JOIN linked b ON b.doc_id // 9 = a.doc_id // 9 AND b.doc_id >= a.doc_id GROUP BY a.doc_id, a.w, a.nxt, a.looped"""))
def includes_expanded(spark, sf):
    return st.expand_includes(include_files(spark, sf))[0]


@query("includes_unresolved", b.with_(FILES, body="""
SELECT 'd' || doc_id || '.tex' AS path, 'nowhere' AS name, 'missing' AS reason FROM linked
UNION ALL SELECT 'd' || doc_id || '.tex', 'd' || nxt, CASE WHEN looped THEN 'loop' ELSE 'missing' END FROM linked WHERE nxt IS NOT NULL AND (looped OR there IS NULL)"""))
def includes_unresolved(spark, sf):
    return st.expand_includes(include_files(spark, sf))[1]


_SPECIALS = "text || ' 50% & $5 #1 a_b {x} ~ ^ \"q\" c:\\d'"


@query("escape_markup", f"""
WITH s AS (SELECT doc_id, {_SPECIALS} AS t FROM documents)
SELECT doc_id, {b.strip('''regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(
  replace(replace(t, '{', chr(1)), '}', chr(2)), chr(92), chr(3)), '&', '\\&'), '%', '\\%'), '$', '\\$'), '#', '\\#'), '_', '\\_'),
  chr(1), '\\{'), chr(2), '\\}'), chr(3), '\\textbackslash{}'), '~', '\\textasciitilde{}'), '^', '\\textasciicircum{}')''' +
  ''', '[ \\t]+', ' ', 'g')''')} AS escaped FROM (SELECT doc_id, replace(t, '"', chr(39) || chr(39)) AS t FROM s)""")
def escape_markup(spark, sf):
    t = F.concat("text", F.lit(" 50% & $5 #1 a_b {x} ~ ^ \"q\" c:\\d"))
    return c.documents(spark, sf).select("doc_id", lx.escape_latex(t).alias("escaped"))


_EQ = ["a_{i} = \\frac{1}{2}", "x $ y", "{a", "\\begin{align}b", "\\input{evil}", "$z$"]


@query("equation_audit", b.with_(b.LINES, f"""
e AS (SELECT doc_id, slide_no, [{', '.join("'" + x + "'" for x in _EQ)}][slide_no % 6 + 1] || ' ' || line AS eq FROM lines),
k AS (SELECT *, list_filter([{', '.join("'" + x + "'" for x in lx.FORBIDDEN)}], lambda t: contains(lower(eq), t))[1] AS bad,
             list_sort(regexp_extract_all(eq, '\\\\begin\\{{(\\w+\\*?)\\}}', 1)) AS opens, list_sort(regexp_extract_all(eq, '\\\\end\\{{(\\w+\\*?)\\}}', 1)) AS closes,
             len(eq) - len(replace(eq, '$', '')) AS dollars, len(replace(eq, '{{', '')) <> len(replace(eq, '}}', '')) AS uneven FROM e)""", body="""
SELECT doc_id, slide_no, CASE WHEN bad IS NOT NULL THEN 'forbidden ' || bad WHEN dollars % 2 = 1 THEN 'dollars' WHEN uneven THEN 'braces'
         WHEN opens <> closes THEN 'environments' ELSE '' END AS problem,
       regexp_matches(eq, '\\\\(frac|begin)\\b|[_^]\\{|\\$') AS is_latex FROM k"""))
def equation_audit(spark, sf):
    eq = F.concat(F.element_at(F.array(*[F.lit(e) for e in _EQ]), (F.col("slide_no") % 6 + 1).cast("int")), F.lit(" "), "line")
    return c.lines(spark, sf).select("doc_id", "slide_no", lx.equation_problem(eq).alias("problem"),
                                     lx.looks_like_latex(eq).alias("is_latex"))


@query("math_delimited", b.with_(KEYED, body="""
SELECT doc_id, CASE WHEN w < 'm' THEN '$' || w || '$' ELSE '\\[a_{' || w || '}\\]' END AS math,
       '(a)/(' || w || ') <= x' AS plain, rtrim('R $\\leq \\varepsilon$ ' || w) AS prose FROM d"""))
def math_delimited(spark, sf):
    eq = F.when(F.col("w") < "m", F.concat(F.lit("$"), "w", F.lit("$"))).otherwise(F.concat(F.lit(" a_{"), "w", F.lit("} ")))
    frac = F.concat(F.lit("$\\frac{a}{"), "w", F.lit("} \\le x$"))
    prose = F.concat(F.lit("R ≤ ε "), "w")
    return keyed_lines(spark, sf).select("doc_id", lx.as_math(eq).alias("math"), lx.strip_math(frac).alias("plain"),
                                         lx.unicode_math_to_text(prose).alias("prose"))
