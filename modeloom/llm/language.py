"""Language identification by prediction by partial matching.

Each language has a byte context tree of orders 0 to 3, kept as sorted arrays: counts of
each gram, and of each context the total and the number of different continuations.  The
probability of a byte follows the longest context known; a byte not seen there escapes to
the next shorter one (method C), and in the end to a uniform byte.  Statistics are frozen
after training, so the cost of a byte depends on it and the three before it, and a worker
looks each such gram up once; the code length of a whole text is the sum over its bytes.
The language with the shortest code wins.

Bytes are folded first: ASCII and Latin-1 letters to lower case, every other ASCII byte to
a blank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modeloom.llm.common import col, fresh, map_rows, table, text_bytes

ORDER = 3
HEAD = 3  # blanks before each text, its first context
UNKNOWN = "und"
PAIRS = 4096  # two-byte pairs with a place of their own in the table of grams


def folding() -> np.ndarray:
    fold = np.full(256, 0x20, np.uint8)
    fold[0x80:] = np.arange(0x80, 0x100)
    low = np.arange(ord("a"), ord("z") + 1)
    fold[low] = low
    fold[low - 32] = low
    return fold


FOLD = folding()


def folded(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of texts with blanks before each; where each text begins, blanks included."""
    n = len(ends) - 1
    at = ends + HEAD * np.arange(n + 1)
    out = np.full(int(at[-1]), 0x20, np.uint8)
    body = np.ones(len(out), bool)
    for k in range(HEAD):
        body[at[:-1] + k] = False
    out[body] = FOLD[data]
    upper = np.flatnonzero((out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)) + 1
    out[upper] += 0x20
    return out, at


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """The last ``size`` bytes at each place from HEAD on, the latest in the low bits."""
    n = len(data) - HEAD
    out = np.zeros(max(n, 0), np.uint32)
    for k in range(size):
        out |= data[HEAD - k : HEAD - k + n].astype(np.uint32) << np.uint32(8 * k)
    return out


class ContextTree:
    """Frozen counts of one language."""

    def __init__(self, counts: dict[int, tuple[np.ndarray, np.ndarray]]):
        """counts: by order the grams, ascending, and how often each occurs."""
        self.orders = []
        for k in range(ORDER + 1):
            gram, n = counts.get(k, (np.zeros(0, np.uint32), np.zeros(0, np.int64)))
            context, first = np.unique(gram >> np.uint32(8), return_index=True)
            total = np.add.reduceat(n, first) if len(gram) else n
            kinds = np.diff(np.append(first, len(gram)))
            self.orders.append((gram, n, context, total, kinds))

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """Code length of the latest byte of each four-byte gram."""
        out, open_ = np.zeros(len(gram)), np.ones(len(gram), bool)
        for k in range(ORDER, -1, -1):
            known, n, context, total, kinds = self.orders[k]
            if not len(known):
                continue
            own = gram & np.uint32((1 << 8 * (k + 1)) - 1)
            c = np.minimum(np.searchsorted(context, own >> np.uint32(8)), len(context) - 1)
            here = open_ & (context[c] == own >> np.uint32(8))
            g = np.minimum(np.searchsorted(known, own), len(known) - 1)
            hit = here & (known[g] == own)
            whole = (total + kinds).astype(np.float64)
            out[hit] -= np.log2(n[g[hit]] / whole[c[hit]])
            miss = here & ~hit
            out[miss] -= np.log2(kinds[c[miss]] / whole[c[miss]])
            open_ &= ~hit
        out[open_] += 8
        return out


class Model:
    """Context trees by language, with the worker's table of grams met so far."""

    def __init__(self, languages: list[str], trees: list[ContextTree]):
        self.languages, self.trees = languages, trees
        self.table = None

    def __getstate__(self):
        return {"languages": self.languages, "trees": self.trees, "table": None}

    def _clear(self) -> None:
        if self.table is None:  # pairs that training has seen get a place; others share place 0 and are looked up each time
            pairs = np.unique(np.concatenate([t.orders[1][0] for t in self.trees] or [np.zeros(0, np.uint32)]))[: PAIRS - 1]
            self.pair = np.zeros(1 << 16, np.uint16)
            self.pair[pairs] = np.arange(1, len(pairs) + 1)
            self.side = len(pairs) + 1
        self.table = np.zeros(self.side * self.side, np.int32)
        self.cost, self.used = np.zeros((len(self.trees), 1 << 16), np.float32), 1

    def rows(self, gram: np.ndarray) -> np.ndarray:
        """Row of each gram in ``cost``."""
        if self.table is None or self.used > 1 << 20:
            self._clear()
        a, b = self.pair[gram >> np.uint32(16)], self.pair[gram & np.uint32(0xFFFF)]
        key = a.astype(np.int32) * self.side + b
        rare = (a == 0) | (b == 0)
        row = self.table[key]
        new = np.flatnonzero((row == 0) | rare)
        if len(new):
            unique, place = np.unique(gram[new], return_inverse=True)
            own = np.arange(self.used, self.used + len(unique), dtype=np.int32)
            while self.used + len(unique) > self.cost.shape[1]:
                self.cost = np.concatenate([self.cost, np.zeros_like(self.cost)], axis=1)
            for k, tree in enumerate(self.trees):
                self.cost[k, own] = tree.bits(unique)
            self.used += len(unique)
            row[new] = own[place]
            keep = new[~rare[new]]
            self.table[key[keep]] = row[keep]
        return row

    def lengths(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Code length in bits of each text (row) under each language (column)."""
        out = np.zeros((len(ends) - 1, len(self.trees)))
        k = 0
        while k < len(ends) - 1:
            m = max(k + 1, int(np.searchsorted(ends, ends[k] + 2_000_000, "right")) - 1)
            text, at = folded(data[ends[k] : ends[m]], ends[k : m + 1] - ends[k])
            row = self.rows(grams(text, ORDER + 1))
            own = np.ones(len(row), bool)  # without the blanks before the next text
            for j in range(HEAD):
                own[at[1:-1] - HEAD + j] = False
            row = row[own]
            begin = ends[k:m] - ends[k]
            full = np.flatnonzero(np.diff(ends[k : m + 1]) > 0)
            if len(full):
                for t in range(len(self.trees)):
                    out[k + full, t] = np.add.reduceat(self.cost[t, row], begin[full], dtype=np.float64)
            k = m
        return out


def held_out(doc_id: str = "doc_id"):
    """Documents that training leaves out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_language: int = 400) -> Model:
    """A model of the non-null ``lang`` values, from a bounded sample of the labelled rows.

    Per language, about ``per_language`` documents give counts by whole text (all, if there are no
    more; held-out ones are left aside): those whose hashed ids lie below the share of all hash
    values that the language's number of documents asks for.  That number is an aggregate that is
    added up before it is shuffled, so no task gets a language's documents; counts of the sample
    are summed on the executors, and the driver gets sums whose number the sample bounds.
    """
    rows = docs.where(~held_out()).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("string")).alias("hash"))
    sizes = rows.groupBy("lang").count().collect()
    if not sizes:
        return Model([], [])
    top = lambda n: (1 << 63) - 1 if n <= per_language else (1 << 64) * per_language // n - (1 << 63)
    bound = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], top(r["count"]))])

    def count(batches):
        for batch in batches:
            for lang in set(batch.column(0).to_pylist()):
                own = batch.filter(pa.compute.equal(batch.column(0), lang))
                text, at = folded(*text_bytes(own.column(1)))
                keep = np.ones(len(text) - HEAD, bool)
                for j in range(HEAD):
                    keep[at[1:-1] - HEAD + j] = False
                for k in range(ORDER + 1):
                    gram, n = np.unique(grams(text, k + 1)[keep], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(np.full(len(gram), k, np.int32)), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "size", "gram", "n"])

    sample = rows.where(F.col("hash") <= bound[F.col("lang")]).dropDuplicates(["id", "lang"])
    sums = sample.select("lang", "text").mapInArrow(count, "lang string, size int, gram long, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")).toPandas()
    trees, languages = [], sorted(sums["lang"].unique())
    for lang in languages:
        own = sums[sums["lang"] == lang].sort_values("gram")
        trees.append(ContextTree({k: (g["gram"].to_numpy().astype(np.uint32), g["n"].to_numpy()) for k, g in own.groupby("size")}))
    return Model(languages, trees)


def predict_columns(model: Model, text: pa.Array, known: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, its posterior probability under equal priors, and code bits a byte; ``known``: texts with a letter."""
    n = len(text)
    if not model.trees:
        return [UNKNOWN] * n, np.zeros(n), np.zeros(n)
    data, ends = text_bytes(text)
    bits = model.lengths(data, ends)
    best = bits.argmin(axis=1)
    low = bits[np.arange(n), best]
    score = 1 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(axis=1)
    has = known.to_numpy(zero_copy_only=False).astype(bool)
    return [model.languages[b] if h else UNKNOWN for b, h in zip(best, has)], np.where(has, score, 0.0), low / np.maximum(np.diff(ends), 1)


def predict(docs: DataFrame, model: Broadcast) -> DataFrame:
    """All columns of ``docs`` and three more: language, score and code bits a byte.

    They are called ``lang_pred``, ``score`` and ``bits_per_byte``, with as many ``_`` behind as
    it takes to differ from the columns of ``docs``, and are the last three.  A text that is null or
    has no letter is ``und`` with score 0; ties go to the first language by name; repeated rows
    and null ids stay; with no language learned all is ``und``; an empty table gives no row.
    Texts are taken in runs of 2 MB; a very long one costs some 60 bytes of memory a byte.
    """
    names = docs.columns
    for base in ("lang_pred", "score", "bits_per_byte"):
        names = [*names, fresh(names, base)]
    n = len(docs.columns)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, t) for c, t in zip(names[n:], (T.StringType(), T.DoubleType(), T.DoubleType()))]])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    wide = docs.select(*map(col, docs.columns), text.alias(names[n]), text.rlike(r"\p{L}").alias(names[n + 1]))

    def work(batch: pa.RecordBatch) -> list:
        return [*batch.columns[:n], *map(pa.array, predict_columns(model.value, batch.column(n), batch.column(n + 1)))]

    return map_rows(wide, work, schema)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents of the table; see :func:`predict` for odd rows."""
    docs = table(spark, sf_dir, "documents")
    model = spark.sparkContext.broadcast(train(docs))
    return predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text"), model).drop("text")
