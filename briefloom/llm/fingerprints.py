"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, subtracted and peeled.

A paragraph is a line that is not blank; its digest is a 64-bit hash. A sketch has cells (count, xor of digests, xor of
check values); a digest goes to one cell in each third. Subtracting two sketches leaves the digests that differ, and
peeling cells that hold exactly one recovers them. When a cell count is too small for the difference, the sketch of
twice the size is tried. Digests are dealt to groups of about ``GROUP`` first and every group is sketched by itself, so
the work is near linear in the number of paragraphs however long a text is.

Everything is built from column functions; no Python runs in the tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP = 16
CELLS = 30  # of the smallest sketch; a multiple of three
ROUNDS = 16  # of peeling; a round takes all pure cells at once
DOUBLINGS = 8
CHUNK = 256  # rows that look for their successor together
CELL = "struct<n:int,id:bigint,chk:bigint>"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digests(text: Column) -> Column:
    """Distinct digests of the paragraphs that are not blank."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))


def groups_of(n: Column) -> Column:
    """How many groups: a power of two, the same for equal texts."""
    return F.when(n <= GROUP, F.lit(0)).otherwise(F.ceil(F.log2(n / GROUP)).cast("int"))


def dealt(ids: Column, power: Column) -> Column:
    """``2**power`` arrays of the digests by their bits, in two steps so that the work is n times the root of that."""
    first = F.floor((power + 1) / 2).cast("int")
    size = lambda p: F.pow(F.lit(2), p).cast("long")

    def part(values: Column, count: Column, shift: int) -> Column:
        return F.transform(F.sequence(F.lit(0).cast("long"), count - 1),
                           lambda g: F.filter(values, lambda x: F.pmod(F.shiftright(x, shift), count) == g))

    fine = F.flatten(F.transform(part(ids, size(first), 0), lambda c: part(c, size(power - first), 24)))
    return F.when(power == 0, F.array(ids)).otherwise(fine)


def _check(x: Column) -> Column:
    return F.xxhash64(x, F.lit("check"))


def _places(x: Column, third: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(x, F.lit(j)), third) + third * j for j in range(3)]


def _placed(ids: Column, third: Column, n) -> Column:
    """Digests with their cells and a sign."""
    return F.transform(ids, lambda x: F.struct(n(x).alias("n"), x.alias("id"), _check(x).alias("chk"),
                                               *[p.alias(f"c{j}") for j, p in enumerate(_places(x, third))]))


def _hits(item: Column, cell: Column) -> Column:
    return (item["c0"] == cell) | (item["c1"] == cell) | (item["c2"] == cell)


def sketch(ids: Column, cells: Column) -> Column:
    """The cells of a set of digests."""
    third = F.floor(cells / 3).cast("long")
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("chk"))
    return let(_placed(ids, third, lambda x: F.lit(1)), lambda items: F.transform(
        F.sequence(F.lit(0).cast("long"), third * 3 - 1),
        lambda c: F.aggregate(F.filter(items, lambda i: _hits(i, c)), empty, lambda a, i: F.struct(
            (a["n"] + 1).alias("n"), a["id"].bitwiseXOR(i["id"]).alias("id"), a["chk"].bitwiseXOR(i["chk"]).alias("chk")))))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["id"].bitwiseXOR(y["id"]).alias("id"),
                                                  x["chk"].bitwiseXOR(y["chk"]).alias("chk")))


def peel(difference: Column, cells: Column) -> Column:
    """Struct of what is left in the cells and the digests recovered: ``plus`` of the first set, ``minus`` of the second."""
    third = F.floor(cells / 3).cast("long")
    start = F.struct(difference.cast(f"array<{CELL}>").alias("cells"), F.array().cast("array<bigint>").alias("plus"),
                     F.array().cast("array<bigint>").alias("minus"))

    def round_(state: Column, _: Column) -> Column:
        pure = F.array_distinct(F.transform(
            F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["chk"] == _check(c["id"]))),
            lambda c: F.struct(c["n"].alias("n"), c["id"].alias("id"), c["chk"].alias("chk"),
                               *[p.alias(f"c{j}") for j, p in enumerate(_places(c["id"], third))])))
        taken = lambda found: F.transform(state["cells"], lambda c, i: F.aggregate(
            F.filter(found, lambda p: _hits(p, i)), c, lambda a, p: F.struct(
                (a["n"] - p["n"]).alias("n"), a["id"].bitwiseXOR(p["id"]).alias("id"), a["chk"].bitwiseXOR(p["chk"]).alias("chk"))))
        of = lambda found, sign: F.transform(F.filter(found, lambda p: p["n"] == sign), lambda p: p["id"])
        return let(pure, lambda found: F.when(F.size(found) == 0, state).otherwise(F.struct(
            taken(found).alias("cells"), F.concat(state["plus"], of(found, 1)).alias("plus"),
            F.concat(state["minus"], of(found, -1)).alias("minus"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_)


def differing(a: Column, b: Column) -> Column:
    """Number of digests in one of two sets only, by sketches; sizes double until the peeling leaves nothing.

    Should every size fail, which takes a collision of 64-bit digests, the sets are compared as they are.
    """
    def attempt(level: Column) -> Column:
        cells = (F.pow(F.lit(2), level) * CELLS).cast("long")
        return let(peel(subtract(sketch(a, cells), sketch(b, cells)), cells), lambda s: F.when(
            F.forall(s["cells"], lambda c: (c["n"] == 0) & (c["id"] == 0) & (c["chk"] == 0)), F.size(s["plus"]) + F.size(s["minus"])))

    tried = F.aggregate(F.sequence(F.lit(0), F.lit(DOUBLINGS)), F.lit(None).cast("int"),
                        lambda found, level: F.when(found.isNotNull(), found).otherwise(attempt(level)))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(0)).otherwise(
        F.coalesce(tried, F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))))


def likeness(a: Column, b: Column) -> Column:
    """Shared over all paragraphs of two sets of digests (1.0 for two empty sets), from their sketches' difference."""
    power = groups_of(F.greatest(F.size(a), F.size(b)))
    pairs = F.arrays_zip(dealt(a, power).alias("a"), dealt(b, power).alias("b"))
    total = F.size(a) + F.size(b)
    gap = F.aggregate(pairs, F.lit(0), lambda s, p: s + differing(p["a"], p["b"]))
    return let(gap, lambda d: F.when(total == 0, F.lit(1.0)).otherwise((total - d) / (total + d)))


def written(ids: Column) -> Column:
    """A set of digests as text: its size and, per group, the cells of the smallest sketch in hexadecimal."""
    power = groups_of(F.size(ids))
    cells = F.transform(dealt(ids, power), lambda g: F.concat_ws(".", F.transform(
        sketch(g, F.lit(CELLS)), lambda c: F.when(c["n"] == 0, F.lit("")).otherwise(
            F.concat_ws("-", c["n"].cast("string"), F.hex(c["id"]), F.hex(c["chk"]))))))
    return F.concat(F.size(ids).cast("string"), F.lit(":"), F.concat_ws(":", cells))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, next_text): each row's successor by ascending key, the first row's for the last.

    Rows are dealt to ranges of keys with about ``CHUNK`` rows each and look inside their range; the first row of the
    next range that has rows serves the last of a range. Rows of equal keys follow each other by a hash of the text;
    rows without a key come first, in order of that hash. Null texts count as empty.
    """
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    span = docs.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(key).alias("n")).first()
    lo, width = span["lo"] or 0, max(1, ((span["hi"] or 0) - (span["lo"] or 0) + 1) * CHUNK // max(1, span["n"]))
    base = (docs.select(F.col(key).alias("key"), value.alias("text")).withColumn("h", F.xxhash64("text"))
            .withColumn("chunk", F.when(F.col("key").isNull(), F.shiftright("h", 54) - 1024)
                        .otherwise(F.floor((F.col("key") - F.lit(lo)) / F.lit(width)).cast("long"))))
    inner = Window.partitionBy("above").orderBy("chunk")
    marks = base.select("chunk").distinct().withColumn("above", F.shiftright("chunk", 10))
    tops = marks.groupBy("above").agg(F.min("chunk").alias("head"))
    # One row per 2**18 documents.
    beyond = tops.select("above", F.coalesce(F.lead("head").over(Window.orderBy("above")), F.min("head").over(Window.partitionBy())).alias("beyond"))
    follows = (marks.withColumn("inside", F.lead("chunk").over(inner)).join(beyond, "above")
               .select("chunk", F.coalesce("inside", "beyond").alias("follower")))
    rows = Window.partitionBy("chunk").orderBy("key", "h")
    # Only the first row of each range per task is shuffled here: Spark limits the groups before the exchange.
    heads = (base.withColumn("place", F.row_number().over(rows)).filter("place = 1")
             .select(F.col("chunk").alias("follower"), F.col("text").alias("head_text")))
    after = follows.join(heads, "follower").select(F.col("chunk").alias("__chunk"), "head_text")
    led = base.withColumn("led", F.lead("text").over(rows))
    return (led.join(after, F.col("chunk") == F.col("__chunk"), "left")
            .select(F.col("key").alias(key), "text", F.coalesce("led", "head_text").alias("next_text")))


def fingerprinted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: length, digest of its edited text, both fingerprints, and the likeness to the edited and to the next text.

    The edited text has its last half (rounded down) replaced by as many first characters of the next text. A null or
    empty text has an empty fingerprint; two texts without paragraphs are alike (1.0). Only these columns are returned.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    texts = (with_next(docs, key, text).withColumn("n_chars", F.length("text").cast("long"))
             .withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))))
    sets = texts.select(key, "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), digests(F.col("text")).alias("own"),
                        digests(F.col("edited")).alias("changed"), digests(F.col("next_text")).alias("following"))
    return sets.select(key, "n_chars", "edited_sha256", written(F.col("own")).alias("fingerprint"), written(F.col("changed")).alias("edited_fingerprint"),
                       likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"))
