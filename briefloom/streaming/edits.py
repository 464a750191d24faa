"""Streams over the append-only edit log.

Order is log order. A late patch is appended, never inserted, so watermarks only bound the memory of the duplicate
check. Sinks write one folder per micro-batch, which makes a repeated batch overwrite itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from briefloom import session
from briefloom.operators import edits as ed
from briefloom.operators import validate as va


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the place the cluster names for checkpoints; only a local session may name none."""
    return f"{session.shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def log_stream(spark: SparkSession, folder: str, file: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder)


def stream_latest_values(ops: DataFrame) -> DataFrame:
    """Final value per (deck, target, field), kept current; run in update mode."""
    return ed.latest_values(ops)


def stream_dedupe(ops: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A patch id applies once; ids are remembered for ``delay`` of event time."""
    return ops.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["patch_id"])


def stream_validate(blocks: DataFrame, strict: bool = True) -> DataFrame:
    """Findings that one arriving block decides alone."""
    return va.row_findings(blocks, strict)


FOLDED = T.StructType([T.StructField("deck_uid", T.LongType()), T.StructField("seq", T.LongType()),
                       T.StructField("patch_id", T.LongType()), T.StructField("state", T.StringType())])
_PATCH = T.StructType([T.StructField("patch_id", T.LongType())])


class UndoRedo(StatefulProcessor):
    """Applied and undone patches per deck. An undo moves the last applied patch over, a redo moves it back, a new
    edit forgets what was undone. Emits every transition; the latest state of a patch is its current one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.applied = handle.getListState("applied", _PATCH)
        self.undone = handle.getListState("undone", _PATCH)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        applied = [r[0] for r in self.applied.get()] if self.applied.exists() else []
        undone = [r[0] for r in self.undone.get()] if self.undone.exists() else []
        for frame in rows:
            out = []
            for seq, patch, control in frame.sort_values("seq")[["seq", "patch_id", "control"]].itertuples(index=False):
                if control == "undo":
                    if not applied:
                        continue
                    patch = applied.pop()
                    undone.append(patch)
                    out.append((key[0], seq, patch, "undone"))
                elif control == "redo":
                    if not undone:
                        continue
                    patch = undone.pop()
                    applied.append(patch)
                    out.append((key[0], seq, patch, "applied"))
                else:
                    undone.clear()
                    applied.append(patch)
                    out.append((key[0], seq, patch, "applied"))
            yield pd.DataFrame(out, columns=FOLDED.names)
        self.applied.put([(int(p),) for p in applied]) if applied else self.applied.clear()
        self.undone.put([(int(p),) for p in undone]) if undone else self.undone.clear()

    def close(self) -> None:
        pass


def stream_fold(log: DataFrame) -> DataFrame:
    """``log``: deck_uid, seq, patch_id, control (edit, undo or redo)."""
    return log.groupBy("deck_uid").transformWithStateInPandas(UndoRedo(), FOLDED, "Append", "None")


def current_state(transitions: DataFrame) -> DataFrame:
    return transitions.groupBy("deck_uid", "patch_id").agg(F.max_by("state", "seq").alias("state"))


def stream_gate(patches: DataFrame, out: str, checkpoint: str):
    """Split a stream into apply, confirm and refuse folders, one partitioned write per micro-batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        ed.confidence_gate(batch).write.mode("overwrite").partitionBy("decision").parquet(f"{out}/batch={batch_id}")

    return patches.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def run_to_table(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over what is there now and return what it wrote, with the batch number."""
    spark = stream.sparkSession
    out = shared_folder(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

    (stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{out}/state")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{out}/data")
