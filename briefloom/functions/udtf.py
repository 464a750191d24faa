"""Points of a text for SQL users: SELECT ... FROM t, LATERAL points(t.text, 12)."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from briefloom.functions import text as tx


def register(spark: SparkSession) -> None:
    """Register the table function ``points(text, limit)``. DataFrame users take the column expression instead."""
    spark.udtf.register("points", F.udtf(_Points, returnType="point_no: int, point: string"))


class _Points:
    """One row per point; a small rendering of the packing rule for text that SQL passes by LATERAL."""

    def eval(self, text: str, limit: int):
        def units(s: str) -> int:
            return len(re.findall(_UNIT, s))

        def tidy(s: str) -> str:
            return s.strip().rstrip(tx.TRAILING_MARKS)

        whole = (text or "").strip()
        if not whole:
            return
        found: list[str] = []
        for sentence in ([whole] if units(whole) <= limit else [s.strip() for s in re.split(_END, whole) if s.strip()]):
            parts = [c for c in re.split(_CLAUSE, sentence) if c.strip()]
            if units(sentence) <= limit or len(parts) < 2:
                found.append(sentence)
                continue
            packed = [parts[0]]
            for part in parts[1:]:
                if units(packed[-1] + part) > limit:
                    packed.append(part)
                else:
                    packed[-1] += part
            points = [tidy(p) for p in packed]
            if len(points) > 1 and units(points[-1]) < max(4, limit // 4):
                points[-2:] = [tidy(points[-2] + points[-1])]
            found += points
        for i, point in enumerate(p for p in found if p):
            yield i + 1, point


_WIDE = tx.IDEOGRAPHS
_UNIT = rf"[{_WIDE}]|[^\W_{_WIDE}][^{_WIDE}{tx.SILENT_MARKS}\s]*"
_END = rf"(?<=[{tx.SENTENCE_ENDS}])\s*"
_CLAUSE = rf"(?<=[{tx.CLAUSE_ENDS}])"
