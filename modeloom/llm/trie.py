"""The trie of prefixes that conversations share, from a global sort.

A conversation is the array of its turns' digests.  Arrays are sorted over all partitions
(equal ones by conv_id, so that no group of copies is dealt to one task), and what each
shares with the one before is its longest common prefix.  A sweep with a stack of the open
path turns these lengths into nodes: what is deeper than the common prefix closes, what
the next array adds opens, and counts move to the parent when a node closes.

Paths that are open where a partition ends go on in the next.  Each partition is told how much
its first array shares with the last before it, and its last with the first behind it; nodes
within these lengths give fragments, and a second sweep over fragments alone, a path for
each partition, adds them up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modeloom.llm.common import discard, table, written
from modeloom.llm.streams import stream_rows

SEQUENCES = "conv_id long, turns array<binary>, sizes array<long>"
SWEPT = "part int, oid long, kind int, depth long, conv long, n_convs long, n_children long, n_leaves long, saved long, ends string, goes_on boolean, began_before boolean"
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NODE, FRAGMENT, END = 0, 1, 2
NONE = hashlib.sha256(b"").hexdigest()


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns, sizes): the digest of each turn's role and text, and the bytes of its text, in order of turn.

    Null turns come first, equal turns in order of role and text; a null role or text is empty; rows without a
    conv_id take no part; other columns are ignored.  One conversation is one row.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    said = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    rows = rows.where("conv_id is not null").withColumns({"key": F.unhex(F.sha2(said.cast("binary"), 256)), "size": F.octet_length("text").cast("long")})
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "key", "size")

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, group in groupby(rows, key=lambda r: r[0]):
            _, keys, sizes = zip(*group)
            yield conv, list(keys), list(sizes)

    return stream_rows(ordered, work, SEQUENCES, 256)


def rebuilt(found: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """Sequences with heads of others: the first h turns of the conversation ``conv_id - conv_id % every``, then the own ones after the first h.

    h is the unsigned CRC-32 of the decimal conv_id modulo ``most``; a head that is shorter is taken whole, one that
    is not there is empty.
    """
    heads = found.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), *[F.slice(c, 1, most - 1).alias(f"head_{c}") for c in ("turns", "sizes")])
    own = found.withColumns({"h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int"), "base": F.col("conv_id") - F.col("conv_id") % every})

    def joined(c: str) -> Column:
        tail = F.slice(c, F.col("h") + 1, F.greatest(F.size(c) - F.col("h"), F.lit(0)))
        return F.when(F.col(f"head_{c}").isNull(), tail).otherwise(F.concat(F.slice(f"head_{c}", F.lit(1), F.col("h")), tail)).alias(c)

    return own.join(heads, "base", "left").select("conv_id", joined("turns"), joined("sizes"))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share; -1 where one is null."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.coalesce(F.when(differs == 0, F.size(a)).otherwise(differs - 1).cast("long"), F.lit(-1).cast("long"))


def sweep(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Nodes, fragments and ends of sorted partitions; the first row of each (part, 0, last array, [left, right], null) has its borders.

    ``oid`` counts the nodes of a partition as they open.  A node that may have begun before or goes on gives a fragment without its
    own leaf, and its ends one by one; the bytes of its text are taken off where it begins.
    """
    for part, group in groupby(rows, key=lambda r: r[0]):
        _, _, last, (left, right), _ = next(group)
        stack: list[list] = []  # oid, conv, n, children, leaves, saved, size, digest of ends, began before, goes on
        opened, before = 0, None

        def close() -> tuple:
            oid, conv, n, children, leaves, saved, size, ends, began, on = stack.pop()
            saved += n * size - (0 if began else size)
            spans = began or on
            leaves += children == 0 and not spans
            if stack:
                up = stack[-1]
                up[1], up[2], up[4], up[5] = min(up[1], conv), up[2] + n, up[4] + leaves, up[5] + saved
            return part, oid, FRAGMENT if spans else NODE, len(stack), conv, n, children, leaves, saved, None if spans else ends.hexdigest() if ends else NONE, on, began

        for _, _, turns, sizes, conv in group:
            if before is None:
                shared = 0
                stack.append([0, conv, 0, 0, 0, 0, 0, None, left >= 0, right >= 0])
                opened = 1
            else:
                shared = 0
                for x, y in zip(before, turns):
                    if x != y:
                        break
                    shared += 1
                while len(stack) > shared + 1:
                    yield close()
            for d in range(shared, len(turns)):
                up, began = stack[-1], before is None and d < left
                up[3] += not began
                stack.append([opened, conv, 0, 0, 0, 0, sizes[d], None, began, up[9] and d < right and turns[d] == last[d]])
                opened += 1
            top = stack[-1]
            top[1], top[2] = min(top[1], conv), top[2] + 1
            if top[8] or top[9]:
                yield part, top[0], END, None, conv, None, None, None, None, None, None, None
            elif top[7] is None:
                top[7] = hashlib.sha256(str(conv).encode())
            else:
                top[7].update(b",%d" % conv)
            before = turns
        while stack:
            yield close()


def stitch(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Adds up fragments, sorted by partition, those that end there first, from the deepest; each gets the sums of its node.

    ``rows`` and result: part, oid, depth, conv, n, children, leaves, saved, goes_on, began_before; in the result goes_on is false for the node's last fragment, and there is no more.
    """
    still: dict[int, list] = {}  # depth: conv, n, children, leaves, saved, leaves found late, fragments
    for part, oid, depth, conv, n, children, leaves, saved, on, began in rows:
        t = still[depth] if began else [conv, 0, 0, 0, 0, 0, []]
        still[depth] = t
        t[0], t[1], t[2], t[3], t[4] = min(t[0], conv), t[1] + n, t[2] + children, t[3] + leaves, t[4] + saved
        t[6].append((part, oid))
        if not on:
            late = t[5] + (t[2] == 0)
            if depth:
                still[depth - 1][5] += late
            for k, (p, o) in enumerate(t[6], 1):
                yield p, o, depth, t[0], t[1], t[2], t[3] + late, t[4], k < len(t[6])
            del still[depth]


def with_parents(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Nodes with the conv of their parent, from nodes in the order in which they opened (part, oid, depth, conv, n, children, leaves, saved, ends, goes_on)."""
    for _, group in groupby(rows, key=lambda r: r[0]):
        path: list[int] = []
        for _, _, depth, conv, n, children, leaves, saved, ends, on in group:
            del path[depth:]
            if not on:
                yield conv, depth, path[-1] if path else None, n, children, leaves, saved, ends
            path.append(conv)


def ends_of(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The digest of each node's ends, from sorted (conv_id, depth, end)."""
    for (conv, depth), group in groupby(rows, key=lambda r: r[:2]):
        made = hashlib.sha256()
        for k, (_, _, end) in enumerate(group):
            made.update((b",%d" if k else b"%d") % end)
        yield conv, depth, made.hexdigest()


def prefix_trie(found: DataFrame) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``found``: conv_id (long, unique, not null), turns (binary digests), sizes (bytes of texts).  A conversation without turns
    is a member of the root; equal conversations are members of the same nodes; an empty table has no node.
    Tasks stream over sorted rows and hold the open path, so memory is that of the longest conversation.
    """
    spark = found.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = written(found, "sequences")
    # the borders of a range partition are drawn from a sample, so what they gave is written
    ordered = written(rows.repartitionByRange(parts, "turns", "conv_id").withColumn("part", F.spark_partition_id()), "sorted")
    order = Window.orderBy("part")
    edges = ordered.groupBy("part").agg(F.min("turns").alias("first"), F.max("turns").alias("last"))
    borders = edges.select("part", F.lit(0).alias("kind"), F.col("last").alias("turns"), F.array(common_prefix(F.lag("last").over(order), F.col("first")), common_prefix(F.col("last"), F.lead("first").over(order))).alias("sizes"), F.lit(None).cast("long").alias("conv_id"))
    members = ordered.select("part", F.lit(1).alias("kind"), "turns", "sizes", "conv_id")
    deal = lambda df, *columns: df.repartition(parts, "part").sortWithinPartitions("part", *columns)
    swept = written(stream_rows(deal(members.unionByName(borders), "kind", "turns", "conv_id"), sweep, SWEPT), "swept")
    discard(rows, ordered)
    stats = ["depth", "conv", "n_convs", "n_children", "n_leaves", "saved"]
    open_ = swept.where(F.col("kind") == FRAGMENT).select("part", "oid", *stats, "goes_on", "began_before")
    one = open_.repartition(1).sortWithinPartitions("part", "goes_on", F.desc("depth"))
    spans = written(stream_rows(one, stitch, "part int, oid long, depth long, conv long, n_convs long, n_children long, n_leaves long, saved long, goes_on boolean"), "spans")
    ends = swept.where(F.col("kind") == END).select("part", "oid", F.col("conv").alias("end"))
    ends = ends.join(spans.select("part", "oid", "conv", "depth"), ["part", "oid"]).select("conv", "depth", "end")
    ends = stream_rows(ends.repartition("conv", "depth").sortWithinPartitions("conv", "depth", "end"), ends_of, "conv long, depth long, ends string")
    spans = spans.join(ends, ["conv", "depth"], "left").select("part", "oid", *stats, F.coalesce("ends", F.lit(NONE)).alias("ends"), "goes_on")
    whole = swept.where(F.col("kind") == NODE).select("part", "oid", *stats, "ends", "goes_on")
    return stream_rows(deal(whole.unionByName(spans), "oid"), with_parents, NODES)


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations; see :func:`sequences`, :func:`rebuilt` and :func:`prefix_trie` for odd rows."""
    return prefix_trie(rebuilt(sequences(table(spark, sf_dir, "conversations"))))
