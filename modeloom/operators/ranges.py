"""Contractions along an ordered label: points against intervals, and against the latest point before.

Intervals.  A label's range is cut into grains, about as long as the mean interval, and every interval into its parts
in the grains that it touches; points and parts meet by grain and are compared there.  A grain with more than ``FULL`` points is cut
into cells of sizes 1, B, B^2 and so on instead, and so is the inside of intervals of many grains: of these, an interval is the
union of few disjoint ones, large ones inside and small ones at its rims.  A point lies in one cell of each size, so point and cell
meet by an equi-join without a residual condition, and both sides are added up by cell and labels before.  So a part
meets ``FULL`` points at most, and nothing else is made for each pair.

Latest before.  Both sides are one table, range-partitioned by key and time (so a key with very many rows is
in many partitions); each partition carries the latest row forward, and what a partition
begins with comes from the ends of those before it, one row of each.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from modeloom.labels import distinct, merge_extents
from modeloom.operators.contract import SEMIRINGS
from modeloom.sources import scratch
from modeloom.tensor import Tensor

#: Cells of a size that make one of the next; sizes at most.
BASE_BITS, MOST_LEVELS = 3, 21
#: Points of a grain with which a part of an interval is compared; full grains whose list is broadcast.
FULL, LISTED = 64, 1 << 16


def ticks(c: Column, kind: T.DataType) -> Column:
    """An ordered label as a whole number: dates as days, times as microseconds."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        # without a detour through the session's time zone, whose days may have 23 hours
        return ((c - F.expr("timestamp_ntz'1970-01-01 00:00:00'")).cast("interval second").cast("decimal(18,6)") * 1_000_000).cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("long")
    raise ValueError(f"a label of type {kind.simpleString()} is not whole numbers, dates or times")


def cover(lo: Column, hi: Column, levels: int) -> Column:
    """The cells (level, cell) whose disjoint union is [lo, hi), for non-negative numbers below 8 ** ``levels``; 14 of a level at most."""
    base, shift = 1 << BASE_BITS, lambda x, n: F.call_function("shiftright", x, n)

    def of_level(k: Column) -> Column:
        # cells of this size that lie inside, less those that make up cells of the next
        bits = k * BASE_BITS
        first, end = shift(lo + (F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1), bits), shift(hi, bits)
        inner, outer = F.shiftright(first + (base - 1), BASE_BITS) * base, F.shiftright(end, BASE_BITS) * base
        left_end = F.when(k == levels - 1, end).otherwise(F.least(inner, end))
        right_begin = F.when(k == levels - 1, end).otherwise(F.greatest(outer, left_end))
        run = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(F.concat(run(first, left_end), run(right_begin, end)), lambda c: F.struct(k.alias("level"), c.alias("cell")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), of_level))


def contract_within(points: Tensor, at: str, intervals: DataFrame, begin: str, end: str, value: str, by: Sequence[str] = (), out: Sequence[str] | None = None, semiring: str = "sum_product") -> Tensor:
    """``C[out] = sum over points and intervals that hold them of their values``, for [begin, end) of the label ``at``.

    ``intervals``: one row each, with the columns ``begin``, ``end``, ``value`` and labels; those in ``by`` must be equal, all others
    are free.  ``out``: which labels stay (default: all but ``at`` and ``by``).  Empty intervals, and rows with a null bound or time, meet nothing.
    Values are added up by cell before they are multiplied, so a null one counts for nothing beside others.
    """
    labels = [c for c in intervals.columns if c not in (begin, end, value)]
    by = distinct(by, "equal labels")
    if lost := [m for m in (*by, at) if m not in points.modes or (m in by and m not in labels)]:
        raise ValueError(f"labels {lost} are not in both operands")
    free = [m for m in points.modes if m not in by and m != at]
    if both := set(free) & set(labels):
        raise ValueError(f"labels {sorted(both)} are free in both operands")
    every = [*points.modes, *[m for m in labels if m not in by]]
    out = tuple(m for m in every if m not in (*by, at)) if out is None else distinct(out, "output")
    if lost := [m for m in out if m not in every]:
        raise ValueError(f"output labels {lost} are in no operand")
    time = lambda df, c: ticks(F.col(c), df.schema[c].dataType)
    span = intervals.select(time(intervals, begin).alias("b"), time(intervals, end).alias("e")).where("b < e").agg(F.min("b"), F.max("e"), F.avg(F.col("e").cast("double") - F.col("b")), F.max(F.col("e") - F.col("b"))).first()
    low, high, mean, longest = span
    if low is None:
        low = high = mean = longest = 0
    if high - low >= 2**62:
        raise ValueError("the intervals span more than 62 bits")
    grain = -(-max(0, int(mean) - 1).bit_length() // BASE_BITS)
    levels = max(0, longest.bit_length() - 1) // BASE_BITS - grain  # above the grain
    add, times = SEMIRINGS[semiring]
    lift = (lambda c: (c != 0).cast("long")) if semiring == "or_and" else lambda c: c
    theirs = [*by, *[m for m in labels if m in out and m not in by]]
    ours = [*by, *[m for m in free if m in out], *([at] if at in out else [])]
    rows = intervals.select(*theirs, lift(F.col(value)).alias("__y"), (time(intervals, begin) - low).alias("__b"), (time(intervals, end) - low).alias("__e")).where("__b < __e")
    own = points.columns("__x").withColumn("__t", time(points.df, at)).where(F.col("__t").between(low, high - 1))
    own = own.select(*ours, lift(F.col("__x")).alias("__x"), (F.col("__t") - low).alias("__t"))
    in_grain = lambda c: F.shiftright(c, BASE_BITS * grain)
    wide = F.lit(1 << BASE_BITS * grain)

    def cells_of(df: DataFrame, cells: Column, names: Sequence[str], v: str) -> DataFrame:
        """Sums by cell and labels."""
        return df.withColumn("__c", F.explode(cells)).select(*names, v, F.col("__c.level").alias("__level"), F.col("__c.cell").alias("__cell")).groupBy(*names, "__level", "__cell").agg(add(v).alias(v))

    def on_levels(begin: int, end: int) -> Column:
        return F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("__t", BASE_BITS * k).alias("cell")) for k in range(begin, end)])

    # parts: of all grains of an interval, or of those that do not make up larger cells
    first, end = in_grain(F.col("__b")), in_grain(F.col("__e") - 1) + 1
    grains = F.sequence(first, end - 1)
    pairs = []
    if levels > 0:
        base, whole = 1 << BASE_BITS, in_grain(F.col("__e"))
        inner = F.shiftright(in_grain(F.col("__b") + (wide - 1)) + (base - 1), BASE_BITS)
        outer = F.shiftright(whole, BASE_BITS)
        grains = F.when(inner < outer, F.concat(F.when(first < inner * base, F.sequence(first, inner * base - 1)).otherwise(F.array().cast("array<bigint>")), F.when(outer * base < end, F.sequence(outer * base, end - 1)).otherwise(F.array().cast("array<bigint>")))).otherwise(grains)
        above = F.transform(cover(inner, outer, levels), lambda x: F.struct((x["level"] + (grain + 1)).alias("level"), x["cell"].alias("cell")))
        pairs.append((cells_of(own, on_levels(grain + 1, grain + levels + 1), ours, "__x"), cells_of(rows.where(inner < outer), above, theirs, "__y"), ["__level", "__cell"], F.lit(True)))
    parts = rows.withColumn("__cell", F.explode(grains))
    parts = parts.withColumn("__b", F.greatest(F.col("__b"), F.col("__cell") * wide)).withColumn("__e", F.least(F.col("__e"), (F.col("__cell") + 1) * wide))
    dots = own.withColumn("__cell", in_grain(F.col("__t")))
    within = (F.col("__t") >= F.col("__b")) & (F.col("__t") < F.col("__e"))
    full = dots.groupBy(*by, "__cell").count().where(F.col("count") > FULL).select(*by, "__cell", F.lit(True).alias("__full"))
    n = full.count()
    if n:
        listed = F.broadcast(full) if n <= LISTED else full
        dots, parts = (x.join(listed, [*by, "__cell"], "left") for x in (dots, parts))
        fuller = F.col("__full").isNotNull()
        pairs.append((cells_of(dots.where(fuller), on_levels(0, grain + 1), ours, "__x"), cells_of(parts.where(fuller), cover(F.col("__b"), F.col("__e"), grain + 1), theirs, "__y"), ["__level", "__cell"], F.lit(True)))
        dots, parts = (x.where(~fuller).drop("__full") for x in (dots, parts))
    pairs.append((dots, parts, ["__cell"], within))
    met = [a.join(b, [*by, *on]).where(within).select(*out, times(F.col("__x"), F.col("__y")).alias("v")) for a, b, on, within in pairs]
    union, total = reduce(DataFrame.unionByName, met), add("v").alias("v")
    df = union.groupBy(*out).agg(total) if out else union.agg(F.coalesce(total, F.lit(0)).alias("v"))
    extents = merge_extents(points.extents, dict.fromkeys(labels))
    made = Tensor(df, out, "v", {m: extents[m] for m in out})
    made.met = union
    return made


def as_of(left: DataFrame, right: DataFrame, on: str, by: Sequence[str], columns: Sequence[str], tasks: int | None = None) -> DataFrame:
    """``left`` with ``columns`` of the latest row of ``right`` that has equal ``by`` and is not later by ``on``; nulls where there is none.

    Of rows of ``right`` at one time the greatest by ``columns`` counts.  Keys in ``by`` may be null, which equals null; rows of ``right``
    without a time count for none, rows of ``left`` without a time get nulls.  The sorted table is written to the shared folder, where it stays as long as the
    result is read; the driver sees one row of each of its ``tasks`` partitions at most.
    """
    spark, by, columns = left.sparkSession, list(by), list(columns)
    if clash := [c for c in columns if c in left.columns]:
        raise ValueError(f"columns {clash} are in both tables")
    own = [c for c in left.columns if c not in (*by, on)]
    kinds = {c: right.schema[c].dataType for c in columns}
    pack = lambda df, names: F.struct(*[F.col(c) for c in names]) if names else F.lit(None)
    a = left.select(*by, on, pack(left, [*own]).alias("__left"), F.lit(1).alias("__side"), F.lit(None).cast(T.StructType([T.StructField(c, k) for c, k in kinds.items()])).alias("__right"))
    b = right.where(F.col(on).isNotNull()).select(*by, on, F.lit(None).cast(a.schema["__left"].dataType).alias("__left"), F.lit(0).alias("__side"), pack(right, columns).alias("__right"))
    both = a.unionByName(b)
    order = [*by, on, "__side", "__right"]
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, "as-of")
    # the borders of a range partition come from a sample, so its result is written
    both.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.schema(T.StructType([*both.schema, T.StructField("__part", T.IntegerType())])).parquet(path)
    before = Window.partitionBy("__part", *by).orderBy(on, "__side", "__right").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = rows.withColumn("__found", F.when(F.col(on).isNotNull(), F.last("__right", ignorenulls=True).over(before)))
    # the end of each partition: its greatest key, and the latest row of that key, which may be in a partition before
    key = F.struct(*[F.col(c) for c in by]) if by else F.lit(0)
    ends = rows.groupBy("__part").agg(F.max(F.struct(key.alias("k"))).alias("k"), F.min(F.struct(key.alias("k"))).alias("first"), F.max(F.when(F.col("__side") == 0, F.struct(key.alias("k"), F.col(on).alias("t"), F.col("__right").alias("r")))).alias("last"))
    carried, state = [], None  # key and row that are carried into a partition
    for r in sorted(ends.collect(), key=lambda r: r["__part"]):
        if state is not None and state[0] == r["first"]["k"]:
            carried.append((r["__part"], *state))
        if r["last"] is not None and r["last"]["k"] == r["k"]["k"]:
            state = (r["k"]["k"], r["last"]["r"])
        elif state is not None and state[0] != r["k"]["k"]:
            state = None
    kind = T.StructType([T.StructField("__part", T.IntegerType()), T.StructField("__key", rows.select(key.alias("k")).schema["k"].dataType), T.StructField("__carry", a.schema["__right"].dataType)])
    carry = F.broadcast(spark.createDataFrame(carried, kind))  # one row of a partition at most
    mine = filled.where("__side = 1").join(carry, "__part", "left")
    late = F.when(F.col(on).isNotNull() & F.col("__key").eqNullSafe(key), F.col("__carry"))
    got = F.coalesce("__found", late)
    return mine.select(*[F.col(c) if c in (*by, on) else F.col("__left").getField(c).alias(c) for c in left.columns], *[got.getField(c).alias(c) for c in columns])
