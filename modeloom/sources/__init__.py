"""Tensors from tables and files, and back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modeloom.labels import distinct
from modeloom.tensor import Tensor, coordinates


def from_table(df: DataFrame, labels: Mapping[str, Column | str], value: Column | str | None = None, agg: str = "sum", kind: str | None = None, extents: Mapping[str, int] | None = None) -> Tensor:
    """A sparse tensor of a table: rows are aggregated by label; rows with a null label are left out.

    ``labels``: label -> column or expression.  ``value``: what is aggregated (None: 1 for
    each row).  ``agg``: sum, min, max, or one (1 wherever there is a row).
    """
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    modes = distinct(list(labels), "table")
    if "v" in modes:
        raise ValueError("'v' is the name of the value")
    rows = df.select(*[as_column(c).alias(m) for m, c in labels.items()], (F.lit(1).cast("long") if value is None else as_column(value)).alias("v"))
    rows = rows.where(" and ".join(f"`{m}` is not null" for m in modes)) if modes else rows
    made = {"sum": F.sum("v"), "min": F.min("v"), "max": F.max("v"), "one": F.lit(1).cast("long")}[agg]
    out = rows.groupBy(*modes).agg((made.cast(kind) if kind else made).alias("v"))
    return Tensor(out, modes, "v", extents)


def from_function(spark: SparkSession, extents: Mapping[str, int], fn, kind: str = "double") -> Tensor:
    """A dense tensor whose value is ``fn`` of the label columns."""
    box = coordinates(spark, extents)
    return Tensor(box.withColumn("v", fn(*[F.col(m) for m in extents]).cast(kind)), tuple(extents), "v", extents, dense=True)


def from_array_column(df: DataFrame, labels: Mapping[str, str], array: str, position: str, extent: int | None = None, kind: str = "double", extents: Mapping[str, int] | None = None) -> Tensor:
    """One row per array element; ``position`` labels the place in the array."""
    rows = df.select(*[F.col(c).alias(m) for m, c in labels.items()], F.posexplode(F.col(array)).alias("__at", "__x"))
    rows = rows.select(*labels, F.col("__at").cast("long").alias(position), F.col("__x").cast(kind).alias("v"))
    return Tensor(rows, (*labels, position), "v", {**(extents or {}), position: extent})


def scratch(spark: SparkSession, tag: str) -> str:
    """A path that nothing uses yet, in the folder that all machines share: ``spark.checkpoint.dir``, or one of our own where all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.gettempdir()
    return f"{folder.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def read(spark: SparkSession, path: str, modes: Sequence[str], value: str = "v", extents: Mapping[str, int] | None = None, dense: bool = False, format: str = "parquet", **options) -> Tensor:
    """A tensor from files of any format that Spark reads (parquet, orc, json, csv, jdbc ...)."""
    return Tensor(spark.read.format(format).options(**options).load(path), modes, value, extents, dense)


def write(tensor: Tensor, path: str, *order: str, format: str = "parquet", partition_by: Sequence[str] = (), mode: str = "overwrite", **options) -> None:
    """Stores a tensor, its labels in the order asked for; what was there is overwritten."""
    tensor.to_df(*order).write.format(format).options(**options).mode(mode).partitionBy(*partition_by).save(path)


def write_all(tensors: Mapping[str, Tensor], folder: str, **options) -> None:
    """Stores several roots, each under its name."""
    for name, t in tensors.items():
        write(t, f"{folder}/{name}", **options)
