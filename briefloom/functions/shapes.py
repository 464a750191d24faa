"""Rectangle arithmetic in page fractions and unit conversion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EMU_PER_POINT = 12700


@dataclass(frozen=True)
class Box:
    """A rectangle given by four columns."""

    x: Column
    y: Column
    w: Column
    h: Column

    @staticmethod
    def of(prefix: str = "") -> Box:
        return Box(*[F.col(prefix + n) for n in ("x", "y", "w", "h")])

    @property
    def x2(self) -> Column:
        return self.x + self.w

    @property
    def y2(self) -> Column:
        return self.y + self.h

    @property
    def cx(self) -> Column:
        return self.x + self.w / 2

    @property
    def cy(self) -> Column:
        return self.y + self.h / 2

    @property
    def area(self) -> Column:
        return self.w * self.h

    @property
    def aspect(self) -> Column:
        return self.w / self.h

    def contains(self, px: Column, py: Column) -> Column:
        return (self.x <= px) & (px <= self.x2) & (self.y <= py) & (py <= self.y2)

    def distance_to(self, px: Column, py: Column) -> Column:
        """0 inside, else the straight distance to the nearest edge or corner."""
        zero = F.lit(0.0)
        dx = F.greatest(self.x - px, zero, px - self.x2)
        dy = F.greatest(self.y - py, zero, py - self.y2)
        return F.sqrt(dx * dx + dy * dy)

    def covered_by(self, other: Box) -> Column:
        """Share of this box that the other covers."""
        zero = F.lit(0.0)
        ix = F.greatest(zero, F.least(self.x2, other.x2) - F.greatest(self.x, other.x))
        iy = F.greatest(zero, F.least(self.y2, other.y2) - F.greatest(self.y, other.y))
        return F.when(self.area > 0, ix * iy / self.area).otherwise(zero)


def emu_to_pt(c: Column) -> Column:
    return c / F.lit(float(EMU_PER_POINT))


def pt_to_emu(c: Column) -> Column:
    return F.bround(c * EMU_PER_POINT, 0).cast("long")


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def aspect_label(w: Column, h: Column) -> Column:
    """A usual ratio within two hundredths, else the ratio to three places."""
    r = w / h
    named = F.when(h <= 0, "16:9")
    for label, value in (("16:9", 16 / 9), ("16:10", 1.6), ("4:3", 4 / 3), ("3:2", 1.5)):
        named = named.when(F.abs(r - value) < 0.02, label)
    return named.otherwise(F.concat(F.format_number(r, 3), F.lit(":1")))


def page_box(left: Column, top: Column, width: Column, height: Column, page_w: Column, page_h: Column) -> Column:
    """Geometry in any unit to page fractions, clamped to the page; null when nothing is left."""
    x, y = clamp(left / page_w), clamp(top / page_h)
    w, h = F.least(F.lit(1.0) - x, width / page_w), F.least(F.lit(1.0) - y, height / page_h)
    return F.when((w > 0) & (h > 0), F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")))


def fit_picture(box_w: Column, box_h: Column, aspect: Column) -> Column:
    """STRUCT(dx, dy, w, h): the picture inside its box, centred, its shape kept (whole units)."""
    wide = aspect > box_w / box_h
    w = F.when(wide, box_w).otherwise(F.floor(box_h * aspect)).cast("long")
    h = F.when(wide, F.floor(box_w / aspect)).otherwise(box_h).cast("long")
    return F.struct(F.floor((box_w - w) / 2).alias("dx"), F.floor((box_h - h) / 2).alias("dy"), w.alias("w"),
                    h.alias("h"))
