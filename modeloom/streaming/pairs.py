"""Contraction of two streams whose elements meet if they are close in time.

Rows of both streams are keyed by the summed labels.  The state of a key holds, for either
side, the elements that a later row of the other may still meet; each batch gives the products that its rows make
with the state and with each other, added up by their free labels.  Elements leave the state once the watermark is ``within`` past them, by
timers for keys that get no more rows.  Every pair is made once, by its later arrival.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from modeloom.labels import plan_contraction
from modeloom.sources import scratch

#: Pairs that are compared at a time.
PAIRS = 1_000_000


class Side:
    """Elements of one side of a key, ordered by time: microseconds, codes of free labels, values."""

    def __init__(self, at: np.ndarray, free: np.ndarray, value: np.ndarray):
        order = np.argsort(at, kind="stable")
        self.at, self.free, self.value = at[order], free[order], value[order]

    def joined(self, other: Side) -> Side:
        return Side(*[np.concatenate([x, y]) for x, y in ((self.at, other.at), (self.free, other.free), (self.value, other.value))])

    def since(self, time: int) -> Side:
        k = int(np.searchsorted(self.at, time))
        return Side(self.at[k:], self.free[k:], self.value[k:])


def pair_sums(a: Side, b: Side, within: int) -> dict[tuple[int, int], object]:
    """Sums of products of the pairs at most ``within`` apart, by the codes of their free labels."""
    out: dict[tuple[int, int], object] = {}
    first, last = np.searchsorted(b.at, a.at - within), np.searchsorted(b.at, a.at + within, "right")
    upto, k = np.cumsum(last - first), 0
    while k < len(a.at):
        m = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + PAIRS, "right")))
        n = last[k:m] - first[k:m]
        i = np.repeat(np.arange(k, m), n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[k:m], n)
        if len(i):
            frame = pd.DataFrame({"a": a.free[i], "b": b.free[j], "v": a.value[i] * b.value[j]})
            for key, v in frame.groupby(["a", "b"])["v"].sum().items():
                out[key] = out.get(key, 0) + v
        k = m
    return out


def contract_streams(left: DataFrame, left_modes: Sequence[str], right: DataFrame, right_modes: Sequence[str], time: str, within: str, lateness: str, value: str = "v", out: Sequence[str] | None = None) -> DataFrame:
    """A stream (out labels..., v) of what each batch adds to ``sum of products over shared labels`` of pairs at most ``within`` apart by ``time``.

    ``lateness``: how far a row may be behind the latest time of its stream; later ones are left out, and Spark counts them
    (``numRowsDroppedByWatermark``).  Rows with a null time, shared label or value make no pair; free labels may be null.  Values are whole numbers or doubles.  The
    stream is for the append mode; its rows are added up by :func:`added_up`.  A key's state is as large as what arrives for it within ``within`` and ``lateness``.
    """
    plan = plan_contraction(left_modes, right_modes, out)
    if not plan.contracted:
        raise ValueError("streams without a shared label")
    spark, keys = left.sparkSession, list(plan.contracted)
    span = int(spark.range(1).select(F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {within}"))).first()[0])
    whole = all(isinstance(s.schema[value].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) for s in (left, right))
    kind = "bigint" if whole else "double"
    free = [(m, left.schema[m].dataType) for m in plan.free_a] + [(m, right.schema[m].dataType) for m in plan.free_b]

    def tagged(df: DataFrame, side: int, own: Sequence[str]) -> DataFrame:
        rows = df.withWatermark(time, lateness).where(" and ".join(f"`{c}` is not null" for c in (*keys, time, value)))
        return rows.select(*keys, F.col(time).alias("__time"), F.lit(side).alias("__side"), F.col(value).cast(kind).alias("__v"), *[(F.col(m) if m in own else F.lit(None).cast(t)).alias(m) for m, t in free])

    both = tagged(left, 0, plan.free_a).unionByName(tagged(right, 1, plan.free_b))
    schema = T.StructType([*[T.StructField(m, dict(free)[m]) for m in plan.out], T.StructField("v", T.LongType() if whole else T.DoubleType())])
    number = np.int64 if whole else np.float64

    def work(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, sides = pickle.loads(state.get[0]) if state.exists else (([], []), None)
        index = [{n: i for i, n in enumerate(own)} for own in names]
        sides = [Side(*x) for x in sides] if sides else [Side(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, number)) for _ in range(2)]
        found: dict[tuple[int, int], object] = {}
        if not state.hasTimedOut:
            for frame in frames:
                at = frame["__time"].astype("datetime64[us]").astype("int64").to_numpy()
                for side, modes in ((0, plan.free_a), (1, plan.free_b)):
                    mine = (frame["__side"] == side).to_numpy()
                    if not mine.any():
                        continue
                    labels = [tuple(None if pd.isna(x) else x for x in row) for row in frame.loc[mine, list(modes)].itertuples(index=False, name=None)] if modes else [()] * int(mine.sum())
                    codes = np.array([index[side].setdefault(n, len(index[side])) for n in labels], np.int64)
                    new = Side(at[mine], codes, frame.loc[mine, "__v"].to_numpy().astype(number))
                    a, b = (new, sides[1]) if side == 0 else (sides[0], new)
                    for k, v in pair_sums(a, b, span).items():
                        found[k] = found.get(k, 0) + v
                    sides[side] = sides[side].joined(new)
        names = [list(own) for own in index]
        if found:
            rows = []
            for (i, j), v in found.items():
                label = dict(zip([*plan.free_a, *plan.free_b], [*names[0][i], *names[1][j]]))
                rows.append([*[label[m] for m in plan.out], v])
            yield pd.DataFrame(rows, columns=[*plan.out, "v"])
        mark = state.getCurrentWatermarkMs()
        sides = [s.since(1000 * mark - span) for s in sides]
        ends = [int(s.at[-1]) for s in sides if len(s.at)]
        if not ends:
            state.remove()
            return
        kept = [np.unique(s.free) for s in sides]  # labels that nothing has any more are forgotten
        names = tuple([own[i] for i in k] for own, k in zip(names, kept))
        sides = [(s.at, np.searchsorted(k, s.free), s.value) for s, k in zip(sides, kept)]
        state.update((pickle.dumps((names, sides)),))
        state.setTimeoutTimestamp(max(mark + 1, (max(ends) + span) // 1000 + 1))

    return both.groupBy(*keys).applyInPandasWithState(work, schema, "state binary", "append", GroupStateTimeout.EventTimeTimeout)


def added_up(changes: DataFrame, folder: str | None = None, out: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """Runs a stream of changes over all that is there, and gives their sums by ``out`` and the number of rows that came too late.

    What each batch adds is a folder of its own in ``folder`` (default: a new one in the shared folder), so a repeated batch adds nothing twice; run again with the
    same folder, it goes on behind the last batch.
    """
    spark = changes.sparkSession
    folder = folder or scratch(spark, "pairs")

    def store(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/changes/batch={batch}")

    running = changes.writeStream.foreachBatch(store).outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    late = sum(op["numRowsDroppedByWatermark"] for p in running.recentProgress for op in p["stateOperators"])
    rows = spark.read.schema(changes.schema).parquet(f"{folder}/changes/batch=*") if any(True for _ in running.recentProgress) else spark.createDataFrame([], changes.schema)
    return rows.groupBy(*out).agg(F.sum("v").alias("v")), late
