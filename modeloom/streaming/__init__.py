"""Contraction of a stream with a static tensor (an extension)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modeloom.labels import plan_contraction
from modeloom.operators.contract import in_range
from modeloom.sources import scratch
from modeloom.tensor import Tensor


def settled(result: DataFrame, tag: str = "stream") -> DataFrame:
    """The result of a streaming aggregate once all that is there has been read.

    Each batch writes the whole result so far as files in the shared folder, in a folder of its own, so
    a repeated batch leaves nothing twice; what the last one wrote is read.  No rows pass the driver.
    """
    spark = result.sparkSession
    folder, batches = scratch(spark, tag), []

    def store(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/{batch}")
        batches.append(batch)

    running = result.writeStream.foreachBatch(store).outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    if not batches:
        return spark.createDataFrame([], result.schema)
    return spark.read.schema(result.schema).parquet(f"{folder}/{max(batches)}")


def contract_stream(stream: DataFrame, modes: Sequence[str], static: Tensor, out: Sequence[str] | None = None, value: str = "v", event_time: str | None = None, lateness: str = "10 minutes", window: str | None = None) -> DataFrame:
    """Running sums of products of stream rows with a static tensor, as a streaming DataFrame.

    Without a window the result is for output modes update and complete.  With ``event_time`` and
    ``window`` it is kept per window, state ends ``lateness`` behind the latest event, and
    append mode works too; later rows are left out.
    """
    plan = plan_contraction(modes, static.modes, out)
    rows = stream.withWatermark(event_time, lateness) if event_time else stream
    known = static.columns("__y")
    joined = rows.withColumnRenamed(value, "__x").join(F.broadcast(in_range(known, static)) if static.small else known, list(plan.contracted))
    keys = [F.window(event_time, window).alias("window")] if event_time and window else []
    return joined.groupBy(*keys, *plan.out).agg(F.sum(F.col("__x") * F.col("__y")).alias("v"))
