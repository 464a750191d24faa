"""Text cleaning, units, sentences, clauses and abridgement as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Character classes. Ranges are written for regular expressions.
IDEOGRAPHS = r"\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff"
SILENT_MARKS = r"\u3000-\u303f\ufe30-\ufe4f\uff00-\uff20\uff3b-\uff40\uff5b-\uff65"
SPACE = r"\t-\r\x1c-\x20\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680"
               "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
               "\u2028\u2029\u202f\u205f\u3000")
INVISIBLE = r"\u200b-\u200f\u202a-\u202e\u2060\ufeff\u00ad"
# Characters that canonical composition can never change; anything else goes to the composing function.
COMPOSED = (r"\x00-\u02ff\u2010-\u2027\u2030-\u205e\u3000-\u3029\u3030-\u3098\u309b-\u30ff\u3400-\u4dbf"
            r"\u4e00-\u9fff\uac00-\ud7a3\uff00-\uff9d\uffa0-\uffef")
# What normalize_text replaces beyond ASCII.
ODD = r"\u00a0\u00ad\u2000-\u200f\u202a-\u202e\u2060\u3000\ufeff"
SENTENCE_ENDS = "。！？；.!?;"
PLAN_SENTENCE_ENDS = "。！？；.!?"
CLAUSE_ENDS = "，,；;"
TRAILING_MARKS = "，,、；;"
CONNECTIVES = ("但在", "但是", "但", "然而", "而", "因此", "从而", "所以", "由于", "为此", "为了", "此外", "同时",
               "并且", "以及", "即", "也就是说", "however", "therefore", "whereas", "while", "although", "because")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sub(c: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(replacement))


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(SPACE_CHARS))


@F.pandas_udf(T.StringType())
def _compose(values: pd.Series) -> pd.Series:
    import unicodedata

    return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


def normalize_text(c: Column | str) -> Column:
    """Canonical text: composed, no invisible marks, single spaces, at most one blank line, stripped.

    Only rows holding characters that composition may change are sent to Python, and only those that hold something to
    replace are rewritten. Each class asks first what most characters fail.
    """
    c = col(c)
    beyond = lambda t: F.octet_length(t) != F.length(t)
    composed = F.coalesce(_compose(F.when(beyond(c) & c.rlike(rf"[[^\x00-\u02ff]&&[^{COMPOSED}]]"), c)), c)
    untidy = beyond(composed) & composed.rlike(rf"[[^\x00-\x9f]&&[{ODD}]]")
    for sign in ("  ", " \n", "\n\n\n", "\t", "\r"):
        untidy = F.contains(composed, F.lit(sign)) | untidy
    out = sub(composed, f"[{INVISIBLE}]", "")
    out = sub(out, r"\r\n?", "\n")
    out = sub(out, r"[ \t\u00a0\u2000-\u200a\u3000]+", " ")
    out = sub(out, r"[ \t]+\n", "\n")
    out = sub(out, r"\n{3,}", "\n\n")
    return F.coalesce(strip(F.when(untidy, out).otherwise(composed)), F.lit(""))


def has_content(c: Column | str) -> Column:
    """Whether anything is left of a text that ``normalize_text`` cleans: a character that is neither blank nor invisible."""
    return col(c).rlike(f"[^{SPACE}{INVISIBLE}]")


# A break ends a word: white space, ideographs and marks that count as white space.
BREAK = IDEOGRAPHS + SILENT_MARKS + SPACE
# The common characters, which a class names first, spare the search through its rare ones.
LETTER = rf"[[0-9A-Za-z][\p{{L}}\p{{N}}&&[^{BREAK}]]]"
# A counted word, from its first letter or digit to the break that ends it. Possessive, so matching is linear.
WORD = rf"{LETTER}[[!-~\u00a1-\u167f][^{BREAK}]]*+"
UNIT = f"(?:{WORD}|[{IDEOGRAPHS}])"
GAP = rf"[^\p{{L}}\p{{N}}{IDEOGRAPHS}]"


def count_units(c: Column | str, language: Column | str | None = None) -> Column:
    """Budget units: ideographs plus words; words alone where ``language`` is ``en``. Marks are free."""
    c = F.coalesce(col(c), F.lit(""))
    units = F.regexp_count(c, F.lit(UNIT))
    if language is None:
        return units
    lang = F.lit(language) if isinstance(language, str) else language
    return F.when(lang == "en", F.regexp_count(c, F.lit(WORD))).otherwise(units)


def _split_after(c: Column, marks: str, swallow: str = "") -> Column:
    return F.split(c, f"(?<=[{marks}]){swallow}")


def sentences(c: Column | str) -> Column:
    """Stripped, non-empty sentences in order."""
    parts = F.transform(_split_after(col(c), SENTENCE_ENDS, f"[{SPACE}]*"), strip)
    return F.filter(parts, lambda s: s != "")


def plan_sentences(c: Column | str) -> Column:
    """The planner's sentences: the plain semicolon does not end one, and pieces are kept as cut."""
    return F.filter(_split_after(col(c), PLAN_SENTENCE_ENDS, f"[{SPACE}]*"), lambda s: strip(s) != "")


def clauses(c: Column | str) -> Column:
    """Clauses with their closing separator; the enumeration comma joins and never cuts."""
    return F.filter(_split_after(col(c), CLAUSE_ENDS), lambda s: strip(s) != "")


def tidy(c: Column | str) -> Column:
    """Strip, then drop closing separators."""
    return F.rtrim(strip(c), F.lit(TRAILING_MARKS))


def _gauge(pieces: Column) -> Column:
    """Pieces with what a running unit count needs, each measured once.

    ``u`` units of the piece alone; ``h`` its first word starts at once and counts; ``t`` its last word runs to the
    end and counts; ``b`` it holds a break. Joining two pieces loses a unit exactly when a counted word spans them.
    """
    # The end is read backwards: a search for its last word from the front would start at every letter.
    starts = rf"^[^{BREAK}\p{{L}}\p{{N}}]*+{LETTER}"
    return F.transform(pieces, lambda p: F.struct(
        p.alias("p"), F.length(p).alias("n"), count_units(p).alias("u"), p.rlike(starts).alias("h"),
        F.reverse(p).rlike(starts).alias("t"), p.rlike(f"[{BREAK}]").alias("b")))


def _joined_units(units: Column, tail: Column, g: Column) -> Column:
    return units + g["u"] - F.when(tail & g["h"], 1).otherwise(0)


def _joined_tail(tail: Column, g: Column) -> Column:
    return g["t"] | (~g["b"] & tail)


def _pack_clauses(parts: Column, limit: Column) -> Column:
    """Greedy packing of clauses up to ``limit`` units, with a short tail folded back."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("u"),
                     F.lit(False).alias("t"))

    def step(acc: Column, g: Column) -> Column:
        units = _joined_units(acc["u"], acc["t"], g)
        full = (acc["open"] != "") & (units > limit)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(tidy(acc["open"])))).otherwise(acc["done"]).alias("done"),
            F.when(full, g["p"]).otherwise(F.concat(acc["open"], g["p"])).alias("open"),
            F.when(full, g["u"]).otherwise(units).alias("u"),
            F.when(full, g["t"]).otherwise(_joined_tail(acc["t"], g)).alias("t"))

    def close(acc: Column) -> Column:
        return F.when(strip(acc["open"]) != "",
                      F.concat(acc["done"], F.array(tidy(acc["open"])))).otherwise(acc["done"])

    packed = F.aggregate(_gauge(parts), empty, step, close)

    def fold_tail(points: Column) -> Column:
        n = F.size(points)
        last = F.element_at(points, -1)
        short = (n > 1) & (count_units(last) < F.greatest(F.lit(4), F.floor(limit / 4)))
        folded = F.concat(F.slice(points, F.lit(1), F.greatest(n - 2, F.lit(0))),
                          F.array(tidy(F.concat(F.try_element_at(points, F.lit(-2)), last))))
        return F.when(short, folded).otherwise(points)

    # Bind the packed array once so that the tail rule does not repeat the fold.
    return F.element_at(F.transform(F.array(packed), fold_tail), 1)


def split_into_points(c: Column | str, limit: Column | int) -> Column:
    """Points of at most ``limit`` units where clean cuts exist: sentences first, then packed clauses."""
    limit = F.lit(limit) if isinstance(limit, int) else limit

    def of_sentence(s: Column) -> Column:
        parts = clauses(s)
        return F.when(count_units(s) <= limit, F.array(s)) \
            .when(F.size(parts) <= 1, F.array(strip(s))) \
            .otherwise(_pack_clauses(parts, limit))

    def of_text(text: Column) -> Column:
        cut = F.filter(F.flatten(F.transform(sentences(text), of_sentence)), lambda p: p != "")
        return F.when(text == "", F.array().cast("array<string>")) \
            .when(count_units(text) <= limit, F.array(text)).otherwise(cut)

    return F.element_at(F.transform(F.array(strip(c)), of_text), 1)


def _longest_prefix(text: Column, marks: str, limit: int) -> Column:
    """Longest prefix that ends right after one of ``marks`` and stays within ``limit`` units; null when none does.

    One linear match finds where the first unit too many begins, a second the last mark before it."""
    within = F.regexp_extract(text, rf"^(?:{GAP}*+{UNIT}){{0,{limit}}}+{GAP}*+", 0)
    kept = strip(F.regexp_extract(within, f"(?s)^(.*[{marks}])", 1))
    trimmed = F.rtrim(kept, F.lit(TRAILING_MARKS + "\u3000 "))
    return F.when((kept != "") & (trimmed != ""), trimmed)


# What no unit starts with: marks, blanks, and the letters and digits among the silent marks.
BETWEEN = rf"[[^\p{{L}}\p{{N}}{IDEOGRAPHS}][{SILENT_MARKS}{SPACE}]]"


def _within(text: Column, limit: Column) -> Column:
    """The text up to where the first unit too many begins, with a limit per row: one linear match, as ``_longest_prefix`` has it."""
    pattern = F.concat(F.lit(rf"^(?:{BETWEEN}*+{UNIT}){{0,"), F.floor(limit).cast("string"), F.lit(rf"}}+{BETWEEN}*+"))
    return F.when(limit >= 0, F.call_function("regexp_extract", text, pattern, F.lit(0)))


def _up_to_mark(within: Column, marks: str) -> Column:
    kept = strip(F.regexp_extract(within, f"(?s)^(.*[{marks}])", 1))
    trimmed = F.rtrim(kept, F.lit(TRAILING_MARKS + "\u3000 "))
    return F.when((kept != "") & (trimmed != ""), trimmed)


def shorten_to(c: Column | str, limit: Column | int) -> Column:
    """Trim to ``limit`` units at the best boundary: sentence, clause, then space; unchanged when none fits."""
    c = col(c)
    boundaries = (SENTENCE_ENDS, "，,、", SPACE)
    if isinstance(limit, int):
        cut = F.coalesce(*[_longest_prefix(c, marks, limit) for marks in boundaries], c)
    else:  # the match is shared by the boundaries
        cut = F.element_at(F.transform(F.array(F.struct(c.alias("text"), _within(c, limit).alias("within"))), lambda x: F.coalesce(
            *[_up_to_mark(x["within"], marks) for marks in boundaries], x["text"])), 1)
    return F.when(count_units(c) <= limit, c).otherwise(cut)


def head_and_tail(c: Column | str, limit: Column | int) -> Column:
    """STRUCT(head, tail): what goes on the page and what is said."""

    def pair(head: Column, tail: Column) -> Column:
        return F.struct(head.alias("head"), tail.alias("tail"))

    def cut(bound: Column) -> Column:
        text, points, total = bound["text"], bound["points"], bound["units"]
        first = F.try_element_at(points, F.lit(1))
        used = count_units(first)
        rest = strip(F.array_join(F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), " "))
        head = shorten_to(text, limit)
        left = F.ltrim(strip(F.substr(text, F.length(head) + 1)), F.lit(TRAILING_MARKS))
        return F.when(total <= limit, pair(text, F.lit(""))) \
            .when((F.size(points) > 1) & ((used <= limit) | (used * 5 <= total * 3)), pair(first, rest)) \
            .when(head == text, pair(text, F.lit(""))) \
            .otherwise(pair(tidy(head), left))

    text = strip(c)
    bound = F.struct(text.alias("text"), split_into_points(text, limit).alias("points"),
                     count_units(text).alias("units"))
    return F.element_at(F.transform(F.array(bound), cut), 1)


def leading_clause(c: Column | str) -> Column:
    """First sentence; when longer than 40 characters its first comma clause, if that has at least 8."""
    c = col(c)
    pieces = F.filter(_split_after(c, SENTENCE_ENDS, f"[{SPACE}]*"), lambda s: strip(s) != "")
    head = F.coalesce(F.try_element_at(pieces, F.lit(1)), c)
    first = F.element_at(F.split(head, "[，,]"), 1)
    cut = (F.length(head) > 40) & head.rlike("[，,]") & (F.length(first) >= 8)
    return F.when(cut, strip(first)).otherwise(strip(head))


def opening_claim(c: Column | str, connectives: tuple[str, ...] = CONNECTIVES) -> Column:
    """The first sentence from the first listed connective that stands past some lead-in."""
    first = F.coalesce(F.try_element_at(sentences(c), F.lit(1)), strip(c))
    found = [F.when(F.instr(first, w) > 7, F.substr(first, F.instr(first, w))) for w in connectives]
    return F.when(F.size(sentences(c)) == 0, strip(c)).otherwise(tidy(F.coalesce(*found, first)))


def split_claim(c: Column | str, limit: Column | int | None = None) -> Column:
    """STRUCT(headline, note): the page line and the spoken remainder (null when nothing remains)."""
    c = col(c)
    nothing = F.lit(None).cast("string")
    parts = plan_sentences(c)

    def pair(head: Column, note: Column) -> Column:
        return F.struct(head.alias("headline"), F.when(note != "", note).alias("note"))

    def cut(bound: Column) -> Column:
        text, pieces = bound["text"], bound["pieces"]
        head = strip(F.try_element_at(pieces, F.lit(1)))
        rest = strip(F.array_join(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), ""))
        if limit is None:
            return F.when((F.size(pieces) <= 1) | (F.length(text) <= 30), pair(text, nothing)).otherwise(
                pair(head, rest))
        cap = F.lit(limit) if isinstance(limit, int) else limit
        whole = head_and_tail(text, limit)
        lead = head_and_tail(head, limit)
        spill = F.when(lead["tail"] != "", strip(F.concat_ws(" ", lead["tail"], rest))).otherwise(rest)
        return F.when((F.size(pieces) <= 1) & (count_units(text) > cap), pair(whole["head"], whole["tail"])) \
            .when((F.size(pieces) <= 1) | (F.length(text) <= 30), pair(text, nothing)) \
            .when(count_units(head) > cap, pair(lead["head"], spill)) \
            .otherwise(pair(head, rest))

    return F.element_at(F.transform(F.array(F.struct(c.alias("text"), parts.alias("pieces"))), cut), 1)


def flatten_space(c: Column | str) -> Column:
    """Words joined by single spaces."""
    return strip(sub(col(c), f"[{SPACE}]+", " "))


def preview(c: Column | str, limit: int = 24) -> Column:
    """Label text: the first ``limit`` characters and an ellipsis."""
    flat = flatten_space(F.coalesce(col(c), F.lit("")))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit), F.lit("…")))


def clip(c: Column | str, width: int = 78) -> Column:
    """Diff text: at most ``width`` characters including the ellipsis."""
    flat = flatten_space(c)
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(F.substring(flat, 1, width - 1), F.lit("…")))


def tidy_title(c: Column | str) -> Column:
    """Drop leading numbering; an empty title becomes the standing one."""
    out = strip(sub(col(c), rf"^[{SPACE}]*\d+(?:\.\d+)*[{SPACE}]*[.、]?[{SPACE}]*", ""))
    return F.when(out != "", out).otherwise(F.lit("内容"))


def continued_title(c: Column | str) -> Column:
    """Mark an overflow page once."""
    c = col(c)
    return F.when(c.endswith("（续）") | c.endswith("(cont.)"), c).otherwise(F.concat(c, F.lit("（续）")))


def merge_note(existing: Column | str, added: Column | str) -> Column:
    """Append a note unless it is already there."""
    existing, added = col(existing), col(added)
    return F.when(existing.isNull() | (existing == ""), added) \
        .when(F.contains(existing, added), existing).otherwise(F.concat_ws(" ", existing, added))


def slugify(c: Column | str) -> Column:
    """Lower case, runs of anything but letters and digits become one dash, none at the ends."""
    return F.btrim(sub(F.lower(F.coalesce(col(c), F.lit(""))), r"[^\p{L}\p{N}]+", "-"), F.lit("-"))


CAPTION_LABEL = (rf"(?i)^[{SPACE}]*(figure|fig\.?|table|tab\.?|图|表)[{SPACE}]*[0-9一二三四五六七八九十]*[{SPACE}]*"
                 rf"[.:：、]?[{SPACE}]*")
CAPTION_NUMBER = (rf"(?i)^[{SPACE}]*(?:图|表|figure|fig\.?|table|tab\.?)[{SPACE}]*[0-9０-９]+[{SPACE}]*[.:：、]?"
                  rf"[{SPACE}]*")


def caption_title(caption: Column | str, fallback: Column | str) -> Column:
    """A caption without its label as page title, when 2 to 40 characters remain."""
    cleaned = strip(sub(col(caption), CAPTION_LABEL, ""))
    return F.when(F.length(cleaned).between(2, 40), cleaned).otherwise(col(fallback))


def caption_text(caption: Column | str) -> Column:
    """A caption without the author's own number."""
    return strip(sub(F.coalesce(col(caption), F.lit("")), CAPTION_NUMBER, ""))


def source_fingerprint(c: Column | str) -> Column:
    """Digest of the normalised text."""
    return F.sha2(normalize_text(c), 256)
