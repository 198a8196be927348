"""What the operators share: the folder all machines see, written tables, batches of rows."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset and all runs in one process, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = kept.get() if kept.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="modeloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder: the lineage ends there, so a lost executor costs no more than a reread."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that no plan still to be run reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release() -> None:
    """Gives back to the machine what this worker has freed; a worker that is used again would keep it beside what its next task needs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(df: DataFrame, *ids: str, text: str = "text") -> DataFrame:
    """The named columns and the text (null: empty), and nothing else, so that no other column's name can clash."""
    return df.select(*[F.col(c).cast("long").alias(c) for c in ids], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def fresh(names: list[str], base: str) -> str:
    """A column name that is not among the names, whatever their case."""
    taken = {n.lower() for n in names}
    while base in taken:
        base += "_"
    return base


def col(name: str) -> Column:
    """A column by its plain name, which may hold dots and backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column without nulls, and where each begins."""
    binary = column.cast(pa.large_binary())
    if isinstance(binary, pa.ChunkedArray):
        binary = binary.combine_chunks()
    ends = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
    data = np.frombuffer(binary.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data, ends - ends[0]


def map_rows(df: DataFrame, f: Callable, schema: T.StructType) -> DataFrame:
    """``mapInArrow`` for columns of any names (its own refuses dots): ``f`` sees and gives them by place."""
    places = lambda n: [f"c{i}" for i in range(n)]
    plain = T.StructType([T.StructField(c, x.dataType) for c, x in zip(places(len(schema)), schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in map(f, batches):
            yield pa.RecordBatch.from_arrays(columns, plain.names)

    return df.toDF(*places(len(df.columns))).mapInArrow(run, plain).toDF(*schema.names)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | dict | None], schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one batch that returns columns by name, or None for nothing."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_arrays([as_array(out[n]) for n in names], names)

    return df.mapInArrow(run, schema)


def fitted(t: pa.Table, schema: T.StructType) -> pa.Table:
    """The table with the Arrow types by which Spark names the schema, whatever the session's time zone: instants stay, only their zone's name changes."""
    want = to_arrow_schema(schema)
    return t if t.schema.types == want.types else pa.table([c if c.type == f.type else zoned(c, f.type) for c, f in zip(t.columns, want)], schema.names)


def zoned(c: pa.ChunkedArray, kind: pa.DataType) -> pa.ChunkedArray:
    """A column cast to a type that differs from its own in names of time zones and of inner fields at most."""
    return pa.chunked_array([_zoned(x, kind) for x in c.chunks], kind)


def _zoned(a: pa.Array, kind: pa.DataType) -> pa.Array:
    if a.type == kind:
        return a
    if pa.types.is_map(kind):
        edges = a.offsets
        made = pa.MapArray.from_arrays(edges, _zoned(a.keys, kind.key_type), _zoned(a.items, kind.item_type), type=kind)
        return pc.if_else(a.is_valid(), made, pa.scalar(None, kind)) if a.null_count else made
    if pa.types.is_list(kind):
        return pa.ListArray.from_arrays(a.offsets, _zoned(a.values, kind.value_type), type=kind, mask=a.is_null() if a.null_count and not a.offset else None)
    if pa.types.is_struct(kind):
        return pa.StructArray.from_arrays([_zoned(a.field(i), f.type) for i, f in enumerate(kind)], fields=list(kind), mask=a.is_null())
    return a.cast(kind)


def as_array(x) -> pa.Array:
    return x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x)
