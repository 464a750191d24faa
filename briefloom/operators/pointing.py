"""From clicks and dragged rectangles to the items they mean.

Anchors and gestures meet on (deck, page, grid, cell). A grid has its own number of columns and of rows, so a flat wide
line lies in a grid of many rows and few columns. An anchor is filed in the finest grid whose cells are just larger than
itself, at most four cells of it, and a point looks up one cell per grid. Pages with very many anchors are thereby cut into
small cells, and no gesture is compared with a whole page.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom import scale
from briefloom.functions.shapes import Box

# How far each kind outranks another.
KIND_PRIORITY = {"block": 1.0, "title": 0.95, "subtitle": 0.9, "figure": 0.9, "table": 0.9, "slide": 0.35}
POINT_GRIDS = ((0, 2, 4), (0, 2, 4, 6, 8))  # cells of 1, 1/4, ... of the page's width, of its height
RECT_GRIDS = ((0, 2), (0, 2, 4))  # coarser, because a rectangle looks up all the cells it covers
TOLERANCE = 0.02
MIN_COVERAGE = 0.45
NEAR_TIE = 0.15
TOP_HITS = 4


def _level(extent: Column, levels: Sequence[int]) -> Column:
    """The finest level whose cells are at least as large."""
    out = F
    for k in sorted(levels, reverse=True)[:-1]:
        out = out.when(extent <= 2.0 ** -k, k)
    return out.otherwise(min(levels))


def _span(low: Column, high: Column, level: Column) -> Column:
    cells = F.pow(F.lit(2.0), level)
    return F.sequence(F.floor(low * cells).cast("int"), F.floor(high * cells).cast("int"))


def _grids(grids: tuple[Sequence[int], Sequence[int]]) -> Column:
    return F.array(*[F.struct(F.lit(x).alias("lx"), F.lit(y).alias("ly")) for x in grids[0] for y in grids[1]])


POINT = ["deck_uid", "slide_index", "px", "py"]
CELL = ["deck_uid", "slide_index", "lx", "ly", "gx", "gy"]


def file_anchors(anchors: DataFrame, margin: float, grids: tuple[Sequence[int], Sequence[int]]) -> DataFrame:
    """Anchors with the cells they touch."""
    b = Box.of()
    a = anchors.withColumns({"lx": _level(b.w + 2 * margin, grids[0]), "ly": _level(b.h + 2 * margin, grids[1])})
    return (a.withColumn("gx", F.explode(_span(b.x - margin, b.x2 + margin, F.col("lx"))))
            .withColumn("gy", F.explode(_span(b.y - margin, b.y2 + margin, F.col("ly")))))


def hit_test(clicks: DataFrame, anchors: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Every anchor within ``tolerance`` of each distinct clicked point, scored.

    Repeated clicks on one point are looked up once and joined back by the caller on (deck, page, point).
    """
    points = clicks.select("deck_uid", "slide_index", "px", "py").distinct()
    at = lambda p, level: F.floor(F.col(p) * F.pow(F.lit(2.0), F.col(level))).cast("int")
    p = points.withColumn("g", F.explode(_grids(POINT_GRIDS))).select(*POINT, "g.lx", "g.ly").withColumns({"gx": at("px", "lx"), "gy": at("py", "ly")})
    hit = p.join(file_anchors(anchors, tolerance, POINT_GRIDS), CELL)
    b, px, py = Box.of(), F.col("px"), F.col("py")
    inside = b.contains(px, py)
    distance = F.when(inside, 0.0).otherwise(b.distance_to(px, py))
    kinds = F.create_map(*[F.lit(x) for kv in KIND_PRIORITY.items() for x in kv])
    proximity = F.when(inside, 1.0).otherwise(1.0 - F.col("distance") / tolerance)
    score = (0.45 * proximity + 0.35 * (1.0 - F.least(F.lit(1.0), b.area))
             + 0.20 * F.coalesce(kinds[F.col("kind")], F.lit(0.5))) * F.col("confidence")
    return (hit.withColumn("distance", distance).filter(F.col("distance") <= tolerance)
            .withColumn("inside", inside).withColumn("score", F.round(score, 4)).drop("lx", "ly", "gx", "gy"))


def top_hits(hits: DataFrame, k: int = TOP_HITS) -> DataFrame:
    return scale.top_rows(hits, POINT, [F.desc("score"), F.asc("uid")], k)


def point_results(clicks: DataFrame, anchors: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Per click: the best hit, its score and whether the runner-up is too close to call."""
    two = top_hits(hit_test(clicks, anchors, tolerance), 2)
    best = two.groupBy(*POINT).agg(
        F.max(F.when(F.col("rank") == 1, F.col("uid"))).alias("uid"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("score"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    best = best.withColumn("ambiguous", F.coalesce(F.round(F.col("score") - F.col("second"), 4) < NEAR_TIE, F.lit(False)))
    return clicks.join(best, POINT, "left")


def lasso(rects: DataFrame, anchors: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Anchors of which a rectangle covers enough, never the page itself. Readers sort by y, then x.

    A rectangle and an anchor may share several cells; the pair is kept only in the cell of their overlap's corner.
    """
    r = rects.select("gesture_id", "deck_uid", "slide_index", *[F.col(n).alias(f"r{n}") for n in ("x", "y", "w", "h")])
    rb = Box.of("r")
    r = (r.withColumn("g", F.explode(_grids(RECT_GRIDS))).withColumns({"lx": F.col("g.lx"), "ly": F.col("g.ly")}).drop("g")
         .withColumn("gx", F.explode(_span(rb.x, rb.x2, F.col("lx")))).withColumn("gy", F.explode(_span(rb.y, rb.y2, F.col("ly")))))
    pair = r.join(file_anchors(anchors.filter(F.col("kind") != "slide"), 0.0, RECT_GRIDS), CELL)
    b = Box.of()
    cells = lambda level: F.pow(F.lit(2.0), F.col(level))
    corner = ((F.floor(F.greatest(b.x, rb.x) * cells("lx")) == F.col("gx"))
              & (F.floor(F.greatest(b.y, rb.y) * cells("ly")) == F.col("gy")))
    coverage = b.covered_by(rb)
    return (pair.filter(corner & (coverage >= min_coverage)).withColumn(
        "score", F.round(coverage * F.col("confidence"), 4))
        .select("gesture_id", "deck_uid", "slide_index", "uid", "x", "y", "score"))


def resolve_selection(gestures: DataFrame, anchors: DataFrame) -> DataFrame:
    """Rectangles select all they cover, points the best hit; a gesture with neither is an error row."""
    has_rect = F.col("w").isNotNull()
    has_point = ~has_rect & F.col("px").isNotNull()
    by_rect = lasso(gestures.filter(has_rect), anchors).select(
        "gesture_id", "uid", F.lit("lasso").alias("gesture"), "score", F.lit(False).alias("ambiguous"))
    points = gestures.filter(has_point).select("gesture_id", *POINT)
    by_point = point_results(points, anchors).filter("uid IS NOT NULL").select(
        "gesture_id", "uid", F.lit("point").alias("gesture"), "score", "ambiguous")
    bad = gestures.filter(~has_rect & ~has_point).select(
        "gesture_id", F.lit(None).cast("string").alias("uid"), F.lit("error").alias("gesture"),
        F.lit(None).cast("double").alias("score"), F.lit(False).alias("ambiguous"))
    return by_rect.unionByName(by_point).unionByName(bad)
