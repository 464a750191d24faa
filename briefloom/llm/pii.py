"""Personal data: labelers vote on candidate spans, expectation-maximisation weighs them, a span classifier decides.

Candidates come from fixed base patterns and from looser ones. Every candidate is seen by labelers: the strict form, a
check of its digits, gazetteers, words in its context, and its borders. The votes of all candidates of the corpus are
counted per pattern; expectation-maximisation on the counts estimates each labeler's reliability, and a logistic span
classifier on form, context and gazetteer features learns the posteriors. Base spans stay whatever the classifier says;
it adds spans.

Texts are only touched by column functions. The driver sees counts per pattern of votes and features, whose number is
bounded by the labelers and kinds, and returns the classifier as a column expression.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.scale import scan

KINDS = ("email", "ip", "card", "phone", "tel", "ssn", "name")
BASE = KINDS[:4]
# The base patterns. Possessive repeats and the looks behind change no match: they keep the matcher from trying the
# rest of a run again and from recursing on long runs. \G is where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "tel": r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z][a-z]+(?:\x20[A-Z][a-z]+)?(?![a-z])",
}
# A pattern can match only where one of these stands; "tel" also takes blanks, so its gate is the end of its own pattern.
NEEDS = {"email": ["@"], "ip": ["."], "phone": ["+"], "name": ["Mr", "Ms", "Dr", "Prof"], "tel": [], "ssn": ["-"], "card": []}
TEL_END = r"[0-9]{3}[\x20.-][0-9]{4}"
# Gazetteers.
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info", "co", "us", "ch", "it", "nl")
GIVEN_NAMES = ("james", "mary", "john", "anna", "robert", "maria", "michael", "linda", "david", "laura", "peter", "julia", "thomas",
               "sarah", "jean", "marie", "pierre", "hans", "karl", "petra", "jose", "carmen", "luis", "ana")
# Words that speak for a kind just before a candidate, and words that speak against any.
CONTEXT = {"email": "mail|contact|write|reach", "ip": r"\bip\b|address|host|server|from|login", "card": "card|visa|mastercard|amex|credit|payment|account",
           "phone": "phone|call|tel|mobile|fax|contact|whatsapp", "tel": "phone|call|tel|mobile|fax|contact", "ssn": "ssn|social|security|tax",
           "name": "name|signed|patient|client|sincerely|by"}
AGAINST = r"isbn|doi|version|\bv\.?$|order|invoice|serial|build|example|sku|case no|article"
LABELERS = ("form", "check", "gazetteer", "context", "border")
NEAR = 30  # characters of context
FOUND = "struct<kind:int,start:int,end:int,value:string>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda s, i: F.element_at(F.transform(
        F.array(F.substr(digits, i, F.lit(1)).try_cast("int") * (1 + (n - i) % 2)), lambda d: s + F.when(d > 9, d - 9).otherwise(d)), 1))
    return (n > 0) & (total % 10 == 0)


def base_valid(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("long"), F.lit(999)) <= 255)
    if kind == "card":
        return F.length(digits).between(14, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(kind == "email")


def located(text: Column, matches: Column, pattern: str, kind: str) -> Column:
    """Matches with their places (code points), from the texts between them."""
    gaps = F.split(text, pattern, -1)
    steps = F.transform(matches, lambda m, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("len"), m.alias("value")))
    spans = scan(steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("start"), F.lit("").alias("value")),
                 lambda s, x: F.struct((s["at"] + x["gap"] + x["len"]).alias("at"), (s["at"] + x["gap"]).alias("start"), x["value"].alias("value")),
                 lambda s: F.struct(F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["at"].alias("end"), s["value"].alias("value")),
                 "struct<at:int,start:int,value:string>", FOUND)
    return F.when(F.size(matches) > 0, spans).otherwise(F.array().cast(f"array<{FOUND}>"))


def with_candidates(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with ``__text`` and ``__found``: the spans of every pattern that could be personal data.

    Of plain digit runs only those of 13 to 19 digits are candidates, of addresses only those with valid parts.
    """
    out = docs.withColumn("__text", text)
    for kind, pattern in PATTERNS.items():
        could = F.rlike("__text", F.lit(TEL_END)) if kind == "tel" else F.lit(True)
        if NEEDS[kind]:
            could = F.contains(F.col("__text"), F.lit(NEEDS[kind][0]))
            for s in NEEDS[kind][1:]:
                could = could | F.contains(F.col("__text"), F.lit(s))
        out = out.withColumn(f"__m_{kind}", F.when(could, F.regexp_extract_all("__text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))

    def worth(kind: str, spans: Column) -> Column:
        if kind == "ip" or kind == "phone":
            return F.filter(spans, lambda s: base_valid(kind, s["value"]))
        if kind == "card":
            return F.filter(spans, lambda s: F.length(_digits(s["value"])).between(13, 19))
        return spans

    found = F.concat(*[worth(k, located(F.col("__text"), F.col(f"__m_{k}"), p, k)) for k, p in PATTERNS.items()])
    return out.withColumn("__found", found).drop(*[f"__m_{k}" for k in KINDS])


def _pick(kind: Column, of: dict[str, Column], other: Column) -> Column:
    out = other
    for k, value in of.items():
        out = F.when(kind == KINDS.index(k), value).otherwise(out)
    return out


def judged(span: Column, text: Column) -> Column:
    """A candidate with ``base`` (it passes the base rules) and the labelers' votes: 1 for, 2 against, 0 none."""
    value, kind, digits = span["value"], span["kind"], _digits(span["value"])
    start, end = span["start"], span["end"]
    before = F.lower(F.substr(text, F.greatest(start + 1 - NEAR, F.lit(1)), F.least(start, F.lit(NEAR))))
    left = F.when(start > 0, F.substr(text, start, F.lit(1))).otherwise(" ")
    right = F.substr(text, end + 1, F.lit(1))
    vote = lambda yes, no: F.when(yes, 1).when(no, 2).otherwise(0)
    base = _pick(kind, {k: base_valid(k, value) for k in BASE}, F.lit(False))
    form = _pick(kind, {
        "email": vote(F.rlike(value, F.lit(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$")), F.lit(True)),
        "ip": vote(~F.rlike(value, F.lit(r"(?:^|\.)0[0-9]")), F.lit(True)),
        "card": vote(F.rlike(value, F.lit(r"^[0-9]{13,19}$|^[0-9]{4}(?:[\x20-][0-9]{4}){3}$")), F.lit(True)),
        "phone": vote(F.rlike(value, F.lit(r"^\+[0-9]{1,3}[\x20.-]?\(?[0-9]")), F.lit(True))}, F.lit(1))
    check = _pick(kind, {"card": vote(luhn(digits), ~luhn(digits)), "email": F.lit(0), "name": F.lit(0), "ip": F.lit(1),
                         "ssn": vote(F.rlike(value, F.lit("^(?!000|666|9)")), F.lit(True))},
                  vote(F.length(digits).between(10, 15), F.lit(True)))
    gazetteer = _pick(kind, {
        "email": vote(F.lower(F.regexp_extract(value, r"\.([A-Za-z]+)$", 1)).isin(*TOP_DOMAINS), F.lit(False)),
        "card": vote(F.rlike(digits, F.lit("^(?:4|5[1-5]|3[47]|6011|65|2[2-7])")), F.lit(True)),
        "ip": vote(~F.rlike(value, F.lit(r"^(?:0|127|255)\.")), F.lit(True)),
        "name": vote(F.exists(F.split(F.lower(value), " "), lambda w: w.isin(*GIVEN_NAMES)), F.lit(False))}, F.lit(0))
    context = F.when(F.rlike(before, F.lit(AGAINST)), 2).otherwise(
        _pick(kind, {k: F.when(F.rlike(before, F.lit(words)), 1).otherwise(0) for k, words in CONTEXT.items()}, F.lit(0)))
    border = vote(~F.rlike(left, F.lit("[A-Za-z0-9_/=.-]")) & ~F.rlike(right, F.lit("[A-Za-z0-9_/=]")), F.lit(True))
    return F.struct(kind.alias("kind"), start.alias("start"), end.alias("end"), base.alias("base"), form.alias("form"), check.alias("check"),
                    gazetteer.alias("gazetteer"), context.alias("context"), border.alias("border"),
                    F.least(F.floor((end - start) / 4), F.lit(7)).cast("int").alias("size"))


def vote_counts(docs: DataFrame, text: Column) -> DataFrame:
    """(kind, votes, size level, number of candidates) over the whole corpus."""
    rows = with_candidates(docs.select(text.alias("__t")), F.col("__t")).filter(F.size("__found") > 0)
    seen = rows.select(F.explode(F.transform("__found", lambda s: judged(s, F.col("__text")))).alias("s"))
    return seen.select("s.kind", *[f"s.{n}" for n in LABELERS], "s.size").groupBy("kind", *LABELERS, "size").agg(F.count(F.lit(1)).alias("n"))


def reliabilities(rows: Sequence[tuple[tuple[int, ...], float]], rounds: int = 100) -> tuple[float, list]:
    """Prior of a true span and P(vote | labeler, truth) from (votes, count) by expectation-maximisation.

    Starts from the majority of votes; a labeler that does not vote says nothing; counts are smoothed.
    """
    def first(v):
        good, bad = sum(x == 1 for x in v), sum(x == 2 for x in v)
        return (good + 1) / (good + 2 * bad + 2)

    truth, prior, table = [first(v) for v, _ in rows], 0.5, []
    for _ in range(rounds):
        total = sum(n for _, n in rows)
        prior = min(0.999, max(0.001, sum(t * n for t, (_, n) in zip(truth, rows, strict=True)) / max(total, 1)))
        table = []
        for j in range(len(LABELERS)):
            cell = {(c, v): 1.0 for c in (0, 1) for v in (1, 2)}
            cell[1, 1] += 1.0  # labelers are taken to be better than chance
            cell[0, 2] += 1.0
            for t, (v, n) in zip(truth, rows, strict=True):
                if v[j]:
                    cell[1, v[j]] += t * n
                    cell[0, v[j]] += (1 - t) * n
            table.append({(c, v): cell[c, v] / (cell[c, 1] + cell[c, 2]) for c in (0, 1) for v in (1, 2)})
        new = [posterior(v, prior, table) for v, _ in rows]
        done = max((abs(a - b) for a, b in zip(new, truth, strict=True)), default=0.0) < 1e-9
        truth = new
        if done:
            break
    return prior, table


def posterior(votes: Sequence[int], prior: float, table: list) -> float:
    z = math.log(prior / (1 - prior)) + sum(math.log(table[j][1, v] / table[j][0, v]) for j, v in enumerate(votes) if v)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _features(kind: int, votes: Sequence[int], size: int) -> list[tuple]:
    return [("constant",), ("kind", kind), ("size", kind, size), *[(name, v) for name, v in zip(LABELERS, votes, strict=True) if v]]


def train(rows: Sequence[tuple[int, tuple[int, ...], int, float, float]], steps: int = 300, rate: float = 0.5) -> dict[tuple, float]:
    """Weights of the span classifier from (kind, votes, size, count, posterior): logistic regression, adaptive steps."""
    weights: dict[tuple, float] = {}
    seen: dict[tuple, float] = {}
    total = sum(r[3] for r in rows) or 1.0
    listed = [(_features(k, v, s), n / total, t) for k, v, s, n, t in rows]
    for _ in range(steps):
        grad: dict[tuple, float] = {}
        for names, share, t in listed:
            z = sum(weights.get(f, 0.0) for f in names)
            off = share * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - t)
            for f in names:
                grad[f] = grad.get(f, 0.0) + off
        for f, g in grad.items():
            g += 1e-4 * weights.get(f, 0.0)
            seen[f] = seen.get(f, 1e-8) + g * g
            weights[f] = weights.get(f, 0.0) - rate * g / math.sqrt(seen[f])
    return weights


def learn(docs: DataFrame, text: Column) -> dict[tuple, float]:
    """The span classifier's weights; without any candidate it has none and accepts nothing."""
    counts = vote_counts(docs, text).collect()
    patterns: dict[tuple[int, ...], float] = {}
    for r in counts:
        v = tuple(r[n] for n in LABELERS)
        patterns[v] = patterns.get(v, 0.0) + r["n"]
    prior, table = reliabilities(sorted(patterns.items()))
    return train(sorted((r["kind"], v := tuple(r[n] for n in LABELERS), r["size"], float(r["n"]), posterior(v, prior, table)) for r in counts))


def accepted(span: Column, weights: dict[tuple, float]) -> Column:
    """Whether the classifier takes a judged span for personal data; failed check digits are a veto."""
    z = F.lit(weights.get(("constant",), -1.0))
    for f, w in sorted(weights.items(), key=str):
        if f[0] == "kind":
            z = z + F.when(span["kind"] == f[1], w).otherwise(0.0)
        elif f[0] == "size":
            z = z + F.when((span["kind"] == f[1]) & (span["size"] == f[2]), w).otherwise(0.0)
        elif f[0] in LABELERS:
            z = z + F.when(span[f[0]] == f[1], w).otherwise(0.0)
    return (z > 0) & (span["check"] != 2)


def with_spans(docs: DataFrame, weights: dict[tuple, float], text: Column) -> DataFrame:
    """``docs`` with ``__base`` and ``__all``: sorted arrays of (start, kind, end), of the base rules and in total.

    A span the classifier adds must not touch a base span.
    """
    rows = with_candidates(docs, text).withColumn("__judged", F.when(
        F.size("__found") > 0, F.transform("__found", lambda s: judged(s, F.col("__text")))))
    place = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    base = F.coalesce(F.array_sort(F.transform(F.filter("__judged", lambda s: s["base"]), place)), none)
    rows = rows.withColumn("__base", base)
    more = F.transform(F.filter("__judged", lambda s: ~s["base"] & accepted(s, weights) & ~F.exists(
        F.col("__base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))), place)
    return rows.withColumn("__all", F.coalesce(F.array_sort(F.concat("__base", more)), none)).drop("__found", "__judged")


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, counts of base spans, their digest, and all spans as text (``kind:start:end``, code points).

    A null text has none. Null and repeated keys give rows of their own; other columns are not returned.
    """
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    weights = learn(docs, value)
    rows = with_spans(docs.select(F.col(key), value.alias("__v")), weights, F.col("__v"))
    count = lambda k: F.size(F.filter("__base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return rows.select(key, *[count(k) for k in BASE], F.sha2(joined(F.col("__base")).cast("binary"), 256).alias("base_sha256"),
                       joined(F.col("__all")).alias("spans"))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; of overlapping spans the first counts.

    A text without spans, null included, stays as it is. All columns stay; helper columns are named with two underscores.
    """
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = with_spans(docs, learn(docs, value), value)
    reach = scan(F.col("__all"), F.struct(F.lit(0).alias("from"), F.lit(0).alias("to")),
                 lambda s, x: F.struct(s["to"].alias("from"), F.greatest(s["to"], x["end"]).alias("to")), lambda s: s["from"],
                 "struct<from:int,to:int>", "int")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    clear = F.filter(F.transform(F.arrays_zip(F.col("__all").alias("s"), reach.alias("r")), lambda x: F.struct(
        x["s"]["start"].alias("start"), x["s"]["end"].alias("end"), x["s"]["kind"].alias("kind"), x["r"].alias("reach"))),
        lambda x: x["start"] >= x["reach"])
    rows = rows.withColumn("__clear", F.when(F.size("__all") > 0, clear))
    parts = F.transform("__clear", lambda x, i: F.concat(F.substr(F.col("__text"), F.when(i == 0, 1).otherwise(F.get(F.col("__clear"), i - 1)["end"] + 1),
                                                                 x["start"] - F.when(i == 0, 0).otherwise(F.get(F.col("__clear"), i - 1)["end"])),
                                                        F.element_at(names, x["kind"] + 1)))
    rest = F.substr(F.col("__text"), F.element_at("__clear", -1)["end"] + 1, F.length("__text"))
    new = F.when(F.size("__all") > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(F.col(text))
    return rows.withColumn(text, new).select(*docs.columns)
