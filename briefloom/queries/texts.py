"""Text queries: units, sentences, points, abridgement, offsets, fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from briefloom.functions import text as tx
from briefloom.operators import provenance as pv
from briefloom.queries import base as b
from briefloom.queries.registry import query
from briefloom.sources import corpus as c


@query("text_units", b.with_(b.LINES, body=f"""
SELECT doc_id, slide_no, {b.units('line')} AS units FROM lines"""))
def text_units(spark, sf):
    return c.lines(spark, sf).select("doc_id", "slide_no", tx.count_units("line").cast("long").alias("units"))


@query("text_units_by_language", b.with_(b.LINES, body=f"""
SELECT l.deck_uid, d.lang, sum({b.units('line')})::BIGINT AS units FROM lines l JOIN documents d USING (doc_id)
GROUP BY ALL"""))
def text_units_by_language(spark, sf):
    d = c.read(spark, sf, "documents")
    units = F.aggregate(F.transform(F.split("text", "\n"), lambda s: tx.count_units(s, F.col("lang"))), F.lit(0),
                        lambda a, x: a + x)
    return (d.select(F.col("source").alias("deck_uid"), "lang", units.alias("u"))
            .groupBy("deck_uid", "lang").agg(F.sum("u").alias("units")))


@query("sentence_split", b.with_(b.SENTS, body="SELECT doc_id, slide_no, block_no, content FROM sents"))
def sentence_split(spark, sf):
    return c.sentence_blocks(spark, sf).select("doc_id", "slide_no", "block_no", "content")


@query("clause_split", b.with_(b.SENTS, body=f"""
SELECT doc_id, slide_no, block_no, unnest({b.clause_list('content')}) AS clause,
       CAST(generate_subscripts({b.clause_list('content')}, 1) AS BIGINT) AS clause_no FROM sents"""))
def clause_split(spark, sf):
    return (c.sentence_blocks(spark, sf)
            .select("doc_id", "slide_no", "block_no", F.posexplode(tx.clauses("content")).alias("p", "clause"))
            .select("doc_id", "slide_no", "block_no", "clause", (F.col("p") + 1).cast("long").alias("clause_no")))


# SQL for points: a recursive fold over clause numbers, independent of the array fold.
def _tidy(x: str) -> str:
    return f"regexp_replace({b.strip(x)}, '[，,、；;]+$', '')"


def points_ctes(limit: int, source: str = "lines", text: str = "line") -> str:
    return f"""
src AS (SELECT doc_id, slide_no, {b.strip(text)} AS t FROM {source}),
parts AS (SELECT doc_id, slide_no, unnest({b.sentence_list('t')}) AS s,
                 generate_subscripts({b.sentence_list('t')}, 1) AS sno FROM src WHERE {b.units('t')} > {limit}),
cut AS (SELECT doc_id, slide_no, sno, s, {b.clause_list('s')} AS cl, {b.units('s')} AS u FROM parts),
fold AS (
  SELECT doc_id, slide_no, sno, cl, 0 AS i, []::VARCHAR[] AS done, '' AS open FROM cut
  WHERE u > {limit} AND len(cl) > 1
  UNION ALL
  SELECT doc_id, slide_no, sno, cl, i + 1,
         CASE WHEN open <> '' AND {b.units("(open || cl[i + 1])")} > {limit}
              THEN list_append(done, {_tidy('open')}) ELSE done END,
         CASE WHEN open <> '' AND {b.units("(open || cl[i + 1])")} > {limit} THEN cl[i + 1]
              ELSE open || cl[i + 1] END
  FROM fold WHERE i < len(cl)),
closed AS (SELECT doc_id, slide_no, sno,
                  CASE WHEN {b.strip('open')} <> '' THEN list_append(done, {_tidy('open')}) ELSE done END AS p
           FROM fold WHERE i = len(cl)),
folded AS (SELECT doc_id, slide_no, sno,
                  CASE WHEN len(p) > 1 AND {b.units('p[len(p)]')} < greatest(4, {limit} // 4)
                       THEN list_append(p[1:len(p) - 2], {_tidy('(p[len(p) - 1] || p[len(p)])')})
                       ELSE p END AS p FROM closed),
whole AS (SELECT doc_id, slide_no, sno, [CASE WHEN u <= {limit} THEN s ELSE {b.strip('s')} END] AS p
          FROM cut WHERE u <= {limit} OR len(cl) <= 1),
pts AS (SELECT doc_id, slide_no, list_filter(flatten(list(p ORDER BY sno)), lambda x: x <> '') AS points
        FROM (SELECT * FROM folded UNION ALL SELECT * FROM whole) GROUP BY ALL
        UNION ALL
        SELECT doc_id, slide_no, CASE WHEN t = '' THEN [] ELSE [t] END FROM src WHERE {b.units('t')} <= {limit})"""


@query("points_packed", b.with_(b.LINES, points_ctes(12), recursive=True, body="""
SELECT doc_id, slide_no, unnest(points) AS point,
       CAST(generate_subscripts(points, 1) AS BIGINT) AS point_no FROM pts"""))
def points_packed(spark, sf):
    return (c.lines(spark, sf)
            .select("doc_id", "slide_no", F.posexplode(tx.split_into_points("line", 12)).alias("p", "point"))
            .select("doc_id", "slide_no", "point", (F.col("p") + 1).cast("long").alias("point_no")))


def shorten_ctes(source: str, x: str, limit: int) -> str:
    """Per row of ``source``: pieces at each kind of boundary, the prefixes that fit, the shortened text."""
    def pieces(mark: str) -> str:
        return f"list_filter(string_split(regexp_replace({x}, '({mark})', '\\1' || chr(1), 'g'), chr(1)), lambda p: p <> '')"

    def kept(p: str) -> str:
        fits = (f"list_filter(list_transform(range(1, least(len({p}), 60) + 1), "
                f"lambda i: array_to_string({p}[1:i], '')), lambda q: {b.units('q')} <= {limit})")
        return f"CASE WHEN len({p}) >= 2 THEN {b.strip(f'({fits})[-1]')} END"

    def final(k: str) -> str:
        return f"nullif(regexp_replace({k}, '[，,、；;\\x{{3000}} ]+$', ''), '')"

    return f"""
sp AS (SELECT doc_id, slide_no, {x} AS whole, {b.units(x)} <= {limit} AS fits, {pieces('[。！？；.!?;]')} AS p1,
              {pieces('[，,、]')} AS p2, {pieces(b.SPACE)} AS p3 FROM {source}),
sk AS (SELECT doc_id, slide_no, whole, fits, {kept('p1')} AS k1, {kept('p2')} AS k2, {kept('p3')} AS k3 FROM sp),
shorts AS (SELECT doc_id, slide_no,
                  CASE WHEN fits THEN whole ELSE coalesce({final('k1')}, {final('k2')}, {final('k3')}, whole) END AS short
           FROM sk)"""


@query("shorten", b.with_(b.LINES, shorten_ctes("lines", "line", 8), body="SELECT * FROM shorts"))
def shorten(spark, sf):
    return c.lines(spark, sf).select("doc_id", "slide_no", tx.shorten_to("line", 8).alias("short"))


@query("head_tail", b.with_(b.LINES, points_ctes(10), shorten_ctes("src", "t", 10), f"""
ready AS (SELECT s.doc_id, s.slide_no, t, points, {b.units('t')} AS total, {b.units('points[1]')} AS first_units,
                 short FROM src s JOIN pts USING (doc_id, slide_no) JOIN shorts USING (doc_id, slide_no))""", recursive=True, body=f"""
SELECT doc_id, slide_no,
       CASE WHEN total <= 10 THEN t
            WHEN len(points) > 1 AND (first_units <= 10 OR first_units * 5 <= total * 3) THEN points[1]
            WHEN short = t THEN t ELSE {_tidy('short')} END AS head,
       CASE WHEN total <= 10 THEN ''
            WHEN len(points) > 1 AND (first_units <= 10 OR first_units * 5 <= total * 3)
              THEN {b.strip("array_to_string(points[2:], ' ')")}
            WHEN short = t THEN ''
            ELSE regexp_replace({b.strip('substr(t, len(short) + 1)')}, '^[，,、；;]+', '') END AS tail
FROM ready"""))
def head_tail(spark, sf):
    out = tx.head_and_tail("line", 10)
    return (c.lines(spark, sf).select("doc_id", "slide_no", out.alias("o"))
            .select("doc_id", "slide_no", "o.head", "o.tail"))


@query("leading_clause", b.with_(b.LINES, f"""
heads AS (SELECT doc_id, slide_no, coalesce({b.sentence_list('line')}[1], {b.strip('line')}) AS h FROM lines)""",
                                 body=f"""
SELECT doc_id, slide_no, CASE WHEN len(h) > 40 AND regexp_matches(h, '[，,]')
   AND len(regexp_split_to_array(h, '[，,]')[1]) >= 8 THEN {b.strip("regexp_split_to_array(h, '[，,]')[1]")}
   ELSE h END AS lead FROM heads"""))
def leading_clause(spark, sf):
    return c.lines(spark, sf).select("doc_id", "slide_no", tx.leading_clause("line").alias("lead"))


WORDS = ("und", "que", "the", "de")


@query("opening_claim", b.with_(b.LINES, f"""
firsts AS (SELECT doc_id, slide_no, {b.sentence_list('line')}[1] AS s, {b.strip('line')} AS t FROM lines)""", body=f"""
SELECT doc_id, slide_no, CASE WHEN s IS NULL THEN t ELSE {_tidy('''coalesce(
   CASE WHEN instr(s, 'und') > 7 THEN substr(s, instr(s, 'und')) END,
   CASE WHEN instr(s, 'que') > 7 THEN substr(s, instr(s, 'que')) END,
   CASE WHEN instr(s, 'the') > 7 THEN substr(s, instr(s, 'the')) END,
   CASE WHEN instr(s, 'de') > 7 THEN substr(s, instr(s, 'de')) END, s)''')} END AS claim FROM firsts"""))
def opening_claim(spark, sf):
    return c.lines(spark, sf).select("doc_id", "slide_no", tx.opening_claim("line", WORDS).alias("claim"))


@query("split_claim", b.with_(b.LINES, f"""
raw AS (SELECT doc_id, slide_no, line,
               list_filter(string_split(regexp_replace(line, '([.!?。！？；]){b.SPACE}*', '\\1' || chr(1), 'g'), chr(1)),
                           lambda s: {b.strip('s')} <> '') AS ss FROM lines)""", body=f"""
SELECT doc_id, slide_no,
       CASE WHEN len(ss) <= 1 OR len(line) <= 30 THEN line ELSE {b.strip('ss[1]')} END AS headline,
       CASE WHEN len(ss) <= 1 OR len(line) <= 30 THEN NULL
            ELSE nullif({b.strip("array_to_string(ss[2:], '')")}, '') END AS note
FROM raw"""))
def split_claim(spark, sf):
    return (c.lines(spark, sf).select("doc_id", "slide_no", tx.split_claim("line").alias("o"))
            .select("doc_id", "slide_no", "o.headline", "o.note"))


@query("labels_clipped", b.with_(b.LINES, f"""
flat AS (SELECT doc_id, slide_no, line, {b.strip(f"regexp_replace(line, '{b.SPACE}+', ' ', 'g')")} AS f FROM lines)""",
                                 body="""
SELECT doc_id, slide_no, CASE WHEN len(f) <= 24 THEN f ELSE substr(f, 1, 24) || '…' END AS label,
       CASE WHEN len(f) <= 78 THEN f ELSE substr(f, 1, 77) || '…' END AS clipped FROM flat"""))
def labels_clipped(spark, sf):
    return c.lines(spark, sf).select("doc_id", "slide_no", tx.preview("line").alias("label"),
                                     tx.clip("line").alias("clipped"))


@query("titles_tidied", b.with_(b.LINES, f"""
t AS (SELECT doc_id, slide_no, slide_no || '.' || doc_id % 4 || ' ' || line AS title FROM lines)""",
                                body=f"""
SELECT doc_id, slide_no,
       CASE WHEN {b.strip("regexp_replace(title, '^[0-9]+(?:[.][0-9]+)* *[.、]? *', '')")} = '' THEN '内容'
            ELSE {b.strip("regexp_replace(title, '^[0-9]+(?:[.][0-9]+)* *[.、]? *', '')")} END AS tidied,
       CASE WHEN slide_no % 3 = 0 THEN title || '（续）' ELSE title || '（续）' END AS continued,
       trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '-') AS slug
FROM t"""))
def titles_tidied(spark, sf):
    title = F.concat(F.col("slide_no"), F.lit("."), F.col("doc_id") % 4, F.lit(" "), F.col("line"))
    t = c.lines(spark, sf).select("doc_id", "slide_no", title.alias("title"))
    marked = F.when(F.col("slide_no") % 3 == 0, tx.continued_title("title")).otherwise(F.col("title"))
    return t.select("doc_id", "slide_no", tx.tidy_title("title").alias("tidied"),
                    tx.continued_title(marked).alias("continued"), tx.slugify("title").alias("slug"))


@query("notes_merged", b.with_(b.SENTS, """
n AS (SELECT doc_id, slide_no, max(CASE WHEN block_no = 1 THEN content END) AS one,
             max(CASE WHEN block_no = 2 THEN content END) AS two FROM sents GROUP BY ALL)""", body="""
SELECT doc_id, slide_no, CASE WHEN two IS NULL THEN one WHEN contains(two, one) THEN two ELSE two || ' ' || one END
  AS note FROM n"""))
def notes_merged(spark, sf):
    pair = c.lines(spark, sf).select("doc_id", "slide_no", tx.sentences("line").alias("s")).filter(F.size("s") > 0)
    one, two = F.try_element_at("s", F.lit(1)), F.try_element_at("s", F.lit(2))
    return pair.select("doc_id", "slide_no", tx.merge_note(two, one).alias("note"))


@query("captions_cleaned", b.with_(b.LINES, f"""
t AS (SELECT doc_id, slide_no, line, CASE WHEN doc_id % 2 = 0 THEN 'Figure ' ELSE '表 ' END || slide_no || ': ' || line AS cap FROM lines),
k AS (SELECT *, {b.strip("substr(cap, instr(cap, ':') + 1)")} AS cleaned FROM t)""", body="""
SELECT doc_id, slide_no, CASE WHEN len(cleaned) BETWEEN 2 AND 40 THEN cleaned ELSE line END AS title,
       cleaned AS text FROM k"""))
def captions_cleaned(spark, sf):
    head = F.when(F.col("doc_id") % 2 == 0, F.lit("Figure ")).otherwise(F.lit("表 "))
    t = c.lines(spark, sf).select("doc_id", "slide_no", "line", F.concat(head, F.col("slide_no"), F.lit(": "), "line").alias("cap"))
    return t.select("doc_id", "slide_no", tx.caption_title("cap", "line").alias("title"),
                    tx.caption_text("cap").alias("text"))


_DIRTY_SQL = ("replace(replace(replace(text, 'é', 'e' || chr(769)), ' ', chr(8203) || '  ' || chr(160)), chr(10), "
              "'  ' || chr(13) || chr(10) || chr(10) || chr(10) || chr(10))")


def _dirty():
    t = F.replace(F.col("text"), F.lit("é"), F.lit("e" + chr(0x301)))
    t = F.replace(t, F.lit(" "), F.lit(chr(0x200B) + "  " + chr(0xA0)))
    return F.replace(t, F.lit("\n"), F.lit("  \r\n\n\n\n"))


@query("text_normalized", f"""
WITH d AS (SELECT doc_id, regexp_replace(nfc_normalize({_DIRTY_SQL}), '[\\x{{200b}}]', '', 'g') AS t FROM documents),
s AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(t, chr(13) || chr(10), chr(10)),
        '[ \\t\\x{{a0}}]+', ' ', 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM d)
SELECT doc_id, {b.strip('t')} AS clean FROM s""")
def text_normalized(spark, sf):
    return c.documents(spark, sf).select("doc_id", tx.normalize_text(_dirty()).alias("clean"))


# ------------------------------------------------------- offsets and provenance


@query("segment_offsets", b.with_(b.LINES, f"""
kept AS (SELECT doc_id, slide_no, {b.strip('line')} AS t FROM lines WHERE {b.strip('line')} <> '')""", body="""
SELECT doc_id, slide_no AS seg_no,
       CAST(coalesce(sum(len(t) + 2) OVER (PARTITION BY doc_id ORDER BY slide_no
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
       CAST(coalesce(sum(len(t) + 2) OVER (PARTITION BY doc_id ORDER BY slide_no
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + len(t) AS BIGINT) AS "end"
FROM kept"""))
def segment_offsets(spark, sf):
    segs = c.lines(spark, sf).select("doc_id", F.col("slide_no").alias("seg_no"), F.col("line").alias("text"))
    return pv.assign_offsets(segs).select("doc_id", "seg_no", "start", "end")


@query("offset_verify", b.with_(b.LINES, f"""
kept AS (SELECT doc_id, slide_no, {b.strip('line')} AS t FROM lines WHERE {b.strip('line')} <> ''),
docs AS (SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY slide_no) AS body FROM kept GROUP BY doc_id),
placed AS (SELECT doc_id, slide_no, t, coalesce(sum(len(t) + 2) OVER (PARTITION BY doc_id ORDER BY slide_no
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM kept),
moved AS (SELECT doc_id, slide_no, t, CASE WHEN doc_id % 10 = 3 THEN s + 1 ELSE s END AS s,
                 CASE WHEN doc_id % 10 = 7 THEN s ELSE s + len(t) END AS e FROM placed)""", body="""
SELECT doc_id, slide_no AS seg_no,
       CASE WHEN s < 0 OR e > len(body) OR e <= s THEN 'invalid_range' ELSE 'drift' END AS problem
FROM moved JOIN docs USING (doc_id)
WHERE s < 0 OR e > len(body) OR e <= s OR substr(body, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT)) <> t"""))
def offset_verify(spark, sf):
    docs = pv.segment_arrays(c.documents(spark, sf).select("doc_id", F.split("text", "\n").alias("pieces")))
    broken = docs.withColumn("segs", F.transform("segs", lambda s: F.struct(
        s["seg_no"].alias("seg_no"), s["text"].alias("text"),
        F.when(F.col("doc_id") % 10 == 3, s["start"] + 1).otherwise(s["start"]).alias("start"),
        F.when(F.col("doc_id") % 10 == 7, s["start"]).otherwise(s["end"]).alias("end"))))
    return pv.verify_offsets(broken)


@query("spans_resolved", """
WITH sp AS (SELECT doc_id, text, unnest(range(0, len(text) // 40 + 1)) AS span_no FROM documents)
SELECT doc_id, CAST(span_no AS BIGINT) AS span_no, substr(text, CAST(40 * span_no AS INTEGER) + 1, 52) AS quote FROM sp""")
def spans_resolved(spark, sf):
    """Overlapping spans over the whole of every document; the last reaches beyond its end."""
    docs = c.documents(spark, sf).select("doc_id", "text")
    spans = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / 40).cast("int"))).alias("span_no")).select(
        "doc_id", F.col("span_no").cast("long").alias("span_no"), (F.col("span_no") * 40).alias("start"), (F.col("span_no") * 40 + 52).alias("end"))
    return pv.resolve_spans(spans, docs).select("doc_id", "span_no", "quote")


@query("source_fingerprints", "SELECT doc_id, sha256(text) AS sha, len(text) AS char_count FROM documents")
def source_fingerprints(spark, sf):
    return c.documents(spark, sf).select("doc_id", tx.source_fingerprint("text").alias("sha"),
                                         F.length("text").cast("long").alias("char_count"))


@query("sources_changed", """
SELECT doc_id, sha256(text) AS old_sha, sha256(text || ' One sentence more.') AS new_sha
FROM documents WHERE doc_id % 10 = 0""")
def sources_changed(spark, sf):
    docs = c.documents(spark, sf).select("doc_id", "text")
    later = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 0,
                                           F.concat("text", F.lit(" One sentence more."))).otherwise(F.col("text")))
    return pv.changed_sources(docs, later)


@query("duration_fit", b.with_(b.LINES, f"""
spoken AS (SELECT deck_uid, sum({b.units('line')}) AS units, count(DISTINCT doc_id) AS docs FROM lines
           GROUP BY deck_uid)""", body="""
SELECT deck_uid, CAST(units AS BIGINT) AS units, CAST(60 * docs AS BIGINT) AS total_seconds,
       round(units * 60 / 140.0, 3)::DOUBLE AS spoken_seconds,
       round(units * 60 / 140.0 / (60 * docs), 4)::DOUBLE AS fit FROM spoken"""))
def duration_fit(spark, sf):
    """Documents to lines to units to seconds against the clock: one partial aggregation, no text shuffled."""
    units = F.aggregate(F.split("text", "\n"), F.lit(0), lambda a, s: a + tx.count_units(s, "en"))
    docs = c.documents(spark, sf).select("deck_uid", units.alias("u"))
    per = docs.groupBy("deck_uid").agg(F.sum("u").cast("long").alias("units"),
                                       (F.count(F.lit(1)) * 60).alias("total_seconds"))
    seconds = F.col("units") * 60 / F.lit(140.0)
    return per.select("deck_uid", "units", "total_seconds", F.round(seconds, 3).alias("spoken_seconds"),
                      F.round(seconds / F.col("total_seconds"), 4).alias("fit"))
