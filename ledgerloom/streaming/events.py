"""Streams of events: windows, sessions and ordered scans with state. The same functions serve batch frames.

Late rows beyond the watermark are dropped by Spark; a volume's pages must come in order, a page that comes late
starts a resweep by `ordered.resweep_seed`.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, size: str, ts: str = "ts", by: str = "event_type", late: str | None = None) -> DataFrame:
    e = events.withWatermark(ts, late) if late else events
    return e.groupBy(F.window(ts, size), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def sliding(events: DataFrame, size: str, step: str, ts: str = "ts", by: str = "event_type", late: str | None = None) -> DataFrame:
    e = events.withWatermark(ts, late) if late else events
    return e.groupBy(F.window(ts, size, step), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def sessions(events: DataFrame, gap: str, ts: str = "ts", by: str = "user_id", late: str | None = None) -> DataFrame:
    e = events.withWatermark(ts, late) if late else events
    return e.groupBy(F.session_window(ts, gap), by).agg(F.count("*").alias("n")).select(by, F.col("session_window.start").alias("start"), "n")


def swept(boxes: DataFrame, key: str = "volume") -> DataFrame:
    """A stream of boxes (key, pos, continuation, locked_id) chained to records; the state of a volume is its greatest and its last id."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = dict(boxes.dtypes)[key]

    def chain(k: tuple, frames: Iterator, state):
        import pandas as pd

        most, last = state.get if state.exists else (0, None)
        for pdf in frames:
            ids = []
            pdf = pdf.sort_values("pos")
            for cont, locked in zip(pdf["continuation"], pdf["locked_id"]):
                gid = int(locked) if locked == locked and locked is not None else last if cont and last is not None else most + 1
                most, last = max(most, gid), gid
                ids.append(gid)
            state.update((most, last))
            yield pd.DataFrame({key: k[0], "pos": pdf["pos"].astype("int64"), "record_id": ids})

    return boxes.groupBy(key).applyInPandasWithState(chain, f"{key} {kind}, pos bigint, record_id bigint", "most bigint, last bigint", "append", GroupStateTimeout.NoTimeout)


def upserted(batch: DataFrame, target: str, key: list[str], order: str) -> None:
    """A micro-batch merged into a Parquet table: the row written last for each key stays. For use with foreachBatch; a batch that is run again changes nothing."""
    from pyspark.sql import Window as W

    spark = batch.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    versions = sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(path)) if fs.exists(path) else []
    old = spark.read.parquet(f"{target}/v{versions[-1]}") if versions else None
    both = batch if old is None else old.unionByName(batch, allowMissingColumns=True)
    w = W.partitionBy(*key).orderBy(F.col(order).desc())
    both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r").write.parquet(f"{target}/v{versions[-1] + 1 if versions else 0}")
