"""Group-wise operators that stay distributed when one group holds most of the rows.

A plain window puts a whole group into one task. The helpers here cut each group into chunks that follow the
window order, work inside the chunks, and add what the earlier chunks contribute. Only one row per chunk meets
in the carry step, so a group of any size spreads over the cluster. Each helper reads its input twice (rows and chunk
totals), so callers that chain several of them cut the lineage in between.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK = 4096
LARGE = 1 << 16  # rows that one window may well hold


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


def with_totals(df: DataFrame, keys: Sequence[str], totals: Mapping[str, Column]) -> DataFrame:
    """Attach group totals to every row.

    Two-phase aggregation combines on the map side, and the join back has one row per group on its small side,
    so adaptive execution may broadcast it or split the hot partitions.
    """
    agg = df.groupBy(*keys).agg(*[c.alias(n) for n, c in totals.items()])
    renamed = agg.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *totals)
    on = [df[k].eqNullSafe(renamed[f"__k_{k}"]) for k in keys]
    return df.join(renamed, on, "left").drop(*[f"__k_{k}" for k in keys])


def _carry(df: DataFrame, keys: Sequence[str], chunk: Sequence[str], aggs: Mapping[str, Column],
           carry: Mapping[str, Column]) -> DataFrame:
    """One row per (keys, chunk) holding what all earlier chunks contribute."""
    before = (Window.partitionBy(*keys).orderBy(*chunk)
              .rowsBetween(Window.unboundedPreceding, -1))
    per_chunk = df.groupBy(*keys, *chunk).agg(*[c.alias(n) for n, c in aggs.items()])
    return per_chunk.select(*_cols(keys), *_cols(chunk),
                            *[c.over(before).alias(n) for n, c in carry.items()])


def _with_carry(here: DataFrame, carried: DataFrame, group: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows of chunks (struct ``__g``) with what their chunk carries.

    A struct is never null, so null keys meet, and the rows are already dealt by it: the join moves only the carry."""
    there = carried.select(F.struct(*group).alias("__carried"), *values)
    return here.join(there, F.col("__g") == F.col("__carried"), "left").drop("__g", "__carried")


def large_groups(df: DataFrame, keys: Sequence[str], rows: int = LARGE) -> DataFrame:
    """The groups of more than ``rows`` rows, one struct of the keys each: at most one row per ``rows`` of the input.

    Tables that follow from one another should share one of these, counted on the first of them."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return counts.filter(F.col("__n") > rows).select(_unnamed(keys).alias("__large"))


def _unnamed(keys: Sequence[str]) -> Column:
    return F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])


def running(df: DataFrame, keys: Sequence[str], chunk: Mapping[str, Column], order: Sequence[Column | str],
            sums: Mapping[str, Column] | None = None, number: str | None = None, large: DataFrame | None = None) -> DataFrame:
    """Exclusive running sums and a row number per group.

    ``chunk`` must be non-decreasing along ``order``. ``sums`` maps an output name to the summed expression; the
    output is the total of the rows before the current one. ``number`` names a 1-based row number. Where ``large``
    (from ``large_groups``) is given, only the groups it lists are cut into chunks; any other is one chunk, so its rows
    leave once and no chunk totals meet.
    """
    sums = dict(sums or {})
    if large is not None:
        # Few rows by the bound of large_groups, whatever the estimate says: the rows themselves need not move for it.
        listed = F.broadcast(large)
        mine = _unnamed(keys) == F.col("__large")
        whole = running_whole(df.join(listed, mine, "left_anti"), keys, order, sums, number)
        return whole.unionByName(running(df.join(listed, mine, "left_semi"), keys, chunk, order, sums, number))
    names = list(chunk)
    base = df.withColumns({n: c for n, c in chunk.items()}).withColumn("__g", F.struct(*keys, *chunk))
    local = Window.partitionBy("__g").orderBy(*order)
    earlier = local.rowsBetween(Window.unboundedPreceding, -1)
    aggs: dict[str, Column] = {f"__t_{n}": F.sum(c) for n, c in sums.items()}
    carry: dict[str, Column] = {f"__t_{n}": F.sum(f"__t_{n}") for n in sums}
    cols = {f"__l_{n}": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for n, c in sums.items()}
    if number:
        cols["__l_number"] = F.row_number().over(local)
        aggs["__t_number"] = F.count(F.lit(1))
        carry["__t_number"] = F.sum("__t_number")
    joined = _with_carry(base.withColumns(cols), _carry(base, keys, names, aggs, carry), [*keys, *names], list(aggs))
    out = {n: F.col(f"__l_{n}") + F.coalesce(F.col(f"__t_{n}"), F.lit(0)) for n in sums}
    if number:
        out[number] = (F.col("__l_number") + F.coalesce(F.col("__t_number"), F.lit(0))).cast("long")
    helpers = [c for c in joined.columns if c.startswith(("__l_", "__t_"))]
    return joined.withColumns(out).drop(*helpers, *names)


def running_whole(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], sums: Mapping[str, Column] | None = None,
                  number: str | None = None) -> DataFrame:
    """``running`` where no group is large (``large_groups`` is empty): its input is read once and stays dealt by the keys."""
    local = Window.partitionBy(*keys).orderBy(*order)
    earlier = local.rowsBetween(Window.unboundedPreceding, -1)
    cols = {n: F.coalesce(F.sum(c).over(earlier), F.lit(0)) for n, c in (sums or {}).items()}
    if number:
        cols[number] = F.row_number().over(local).cast("long")
    return df.withColumns(cols)


def latest_before(df: DataFrame, keys: Sequence[str], chunk: Mapping[str, Column], order: Sequence[Column | str],
                  values: Mapping[str, Column], inclusive: bool = True) -> DataFrame:
    """The latest non-null value at or before each row, per group."""
    names = list(chunk)
    base = df.withColumns({n: c for n, c in chunk.items()}).withColumn("__g", F.struct(*keys, *chunk))
    local = Window.partitionBy("__g").orderBy(*order)
    frame = local.rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    whole = struct_order(order)
    aggs = {f"__t_{n}": F.max_by(c, F.when(c.isNotNull(), whole)) for n, c in values.items()}
    carry = {f"__t_{n}": F.last(f"__t_{n}", ignorenulls=True) for n in values}
    cols = {f"__l_{n}": F.last(c, ignorenulls=True).over(frame) for n, c in values.items()}
    joined = _with_carry(base.withColumns(cols), _carry(base, keys, names, aggs, carry), [*keys, *names], list(aggs))
    out = {n: F.coalesce(F.col(f"__l_{n}"), F.col(f"__t_{n}")) for n in values}
    helpers = [c for c in joined.columns if c.startswith(("__l_", "__t_"))]
    return joined.withColumns(out).drop(*helpers, *names)


def previous(df: DataFrame, keys: Sequence[str], chunk: Mapping[str, Column], order: Sequence[Column | str],
             values: Mapping[str, Column]) -> DataFrame:
    """The value on the row before, per group (null on the first row)."""
    packed = {f"__v_{n}": F.struct(c.alias("v")) for n, c in values.items()}
    base = df.withColumns(packed)
    out = latest_before(base, keys, chunk, order, {f"__p_{n}": F.col(f"__v_{n}") for n in values}, inclusive=False)
    return (out.withColumns({n: F.col(f"__p_{n}.v") for n in values})
            .drop(*packed, *[f"__p_{n}" for n in values]))


def struct_order(order: Sequence[Column | str]) -> Column:
    """The ordering columns as one comparable struct (ascending columns only)."""
    return F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, number: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group. Spark limits each group before the shuffle when ``k`` is a constant."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(number, F.row_number().over(w)).filter(F.col(number) <= F.lit(k))


def position_chunk(column: str | Column, width: int = CHUNK) -> dict[str, Column]:
    """Chunks of consecutive positions."""
    c = F.col(column) if isinstance(column, str) else column
    return {"__chunk": F.floor(c / F.lit(width)).cast("long")}


def scan(arr: Column, zero: Column, step, emit, state_type: str, out_type: str, width: int = 256) -> Column:
    """Running fold over an array inside the row: ``emit(state)`` after every element.

    The fold runs chunk by chunk, so growing the output copies at most one chunk at a time.
    """
    empty = F.array().cast(f"array<{out_type}>")
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(arr) - 1) / width).cast("int"))),
                         lambda i: F.slice(arr, i * width + 1, F.lit(width)))

    def within(acc: Column, x: Column) -> Column:
        nxt = F.array(step(acc["s"], x).cast(state_type))
        return F.element_at(F.transform(nxt, lambda s: F.struct(
            s.alias("s"), F.concat(acc["out"], F.array(emit(s).cast(out_type))).alias("out"))), 1)

    def across(acc: Column, chunk: Column) -> Column:
        part = F.array(F.aggregate(chunk, F.struct(acc["s"].alias("s"), empty.alias("out")), within))
        return F.element_at(F.transform(part, lambda p: F.struct(
            p["s"].alias("s"), F.concat(acc["out"], F.array(p["out"])).alias("out"))), 1)

    start = F.struct(zero.cast(state_type).alias("s"),
                     F.array().cast(f"array<array<{out_type}>>").alias("out"))
    return F.flatten(F.aggregate(chunks, start, across, lambda acc: acc["out"]))


def fixed_table(spark, names: Sequence[str], rows: Sequence[Sequence]) -> DataFrame:
    """A small table of literals, planned inside the JVM."""
    cells = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows]
    return spark.range(0, 1, 1, 1).select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def shingles(text: Column, lengths: Column) -> Column:
    """Every distinct substring of ``text`` whose length is in ``lengths``."""
    return F.array_distinct(F.flatten(F.transform(
        F.filter(lengths, lambda n: n <= F.length(text)),
        lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, n)))))


BUCKETS = 1024  # of hashes of needles that a group's row lists at most


def contains_join(hay: DataFrame, hay_text: str, needles: DataFrame, needle: str, keys: Sequence[str]) -> DataFrame:
    """Pairs where ``needle`` occurs in ``hay_text``, as an equi-join.

    Each text is cut into substrings of the needle lengths its group has, so rows meet only on an exact match and
    no group is multiplied out. A substring leaves its row only if its hash falls where that of some needle of the group does.
    """
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")
    seen = needles.groupBy(*keys).agg(F.collect_set(F.length(needle)).alias("__lengths"), F.collect_set(bucket(F.col(needle))).alias("__buckets"))
    found = F.filter(shingles(F.col(hay_text), F.col("__lengths")), lambda s: F.array_contains("__buckets", bucket(s)))
    cut = hay.join(seen, list(keys)).withColumn("__s", F.explode(found)).drop("__lengths", "__buckets")
    return cut.join(needles.withColumn("__s", F.col(needle)), [*keys, "__s"]).drop("__s")
