"""A Merkle manifest of a table: one tree of digests for each group of rows, and one over the groups.

Where a row stands in its group is found without a global sort.  Ids are cut into digits;
histograms count the rows of each group below each prefix of digits, the finer ones first,
each added up from the one before, and a row's rank is what stands before it at each
level.  Rows with equal ids are ranked the same way by the digits of their digests.

A rank, written to the base of the fanout, is the path of a leaf in its tree, and nodes that
share all digits but the last are one node above.  The longest prefixes are reduced first:
a task takes the ``BLOCK`` leaves that share their leading digits and works up through all
levels in between, so a tree over n leaves takes log(n) / log(BLOCK) shuffles.  Proofs come
down the same way: each block hears what stands beside the path above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modeloom.llm.common import discard, table, written
from modeloom.llm.streams import stream_rows

#: Bits of a digit of ids: a histogram has at most 4,096 cells below one of the level above.
BITS = 12
#: Leaves that one task reduces together, at most.
BLOCK = 1024
#: Copies of one row that are numbered together.
COPIES = 4096

NODE = "g string, pos long, n long, digest string"
PATH = "g string, pos long, above string, subroot string, root string"


def digest(*parts: bytes) -> bytes:
    """Lower-case hexadecimal SHA-256 of the parts in a row."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def field(c: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon and the value."""
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]).cast("binary"), 256)


def label(group: Column) -> Column:
    """A string that is never null and sorts as the group does, null first."""
    return F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group.cast("string")))


# -- ranks


def radix_starts(rows: DataFrame, group: Sequence[str], digits: Sequence[str], spent: list[DataFrame]) -> DataFrame:
    """``rows`` with how many rows of their group stand before them (``start``) and how many it has (``total``).

    ``rows`` has each (group, digits) once, with its number of rows ``n``.  Windows go over the cells below
    one cell only.  Digits are not null.  ``spent`` gets the written tables that the result reads.
    """
    levels = [rows.select(*group, *digits, "n")]
    for d in range(len(digits) - 1, 0, -1):
        levels.append(written(levels[-1].groupBy(*group, *digits[:d]).agg(F.sum("n").alias("n")), "histogram"))
        spent.append(levels[-1])
    out: DataFrame | None = None
    for d, t in enumerate(reversed(levels), 1):
        cell = [*group, *digits[: d - 1]]
        beside = Window.partitionBy(*cell or [F.lit(0)])
        before = beside.orderBy(digits[d - 1]).rowsBetween(Window.unboundedPreceding, -1)
        t = t.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
        if out is None:
            t = t.withColumn("total", F.sum("n").over(beside))
        else:
            t = t.join(out.select(*cell, F.col("start").alias("above"), "total"), cell).withColumn("start", F.col("start") + F.col("above")).drop("above")
        out = t
    return out


def id_digits(low: int | None, high: int | None, name: str = "id") -> dict[str, Column]:
    """Digits of ids between ``low`` and ``high``, the first first; those of a null are all -1."""
    bits = ((low or 0) ^ (high or 0)) & (2**64 - 1)
    key = F.col(name).bitwiseXOR(F.lit(-(2**63)))
    count = max(1, -(-bits.bit_length() // BITS))
    digit = lambda i: F.coalesce(F.shiftrightunsigned(key, BITS * i).bitwiseAND(F.lit(2**BITS - 1)), F.lit(-1))
    return {f"d{i}": digit(count - 1 - i) for i in range(count)}


def placed(leaves: DataFrame, spent: list[DataFrame]) -> DataFrame:
    """(g, pos, n, id, leaf, other): each leaf with its rank in its group of n, by id (null first) and digest.

    ``leaves``: g, id, leaf, other; repeated rows take places one after the other.  ``spent`` gets the written tables that the result reads.
    """
    found = written(leaves.groupBy("g", "id", "leaf").agg(F.min("other").alias("other"), F.count("*").alias("n")), "leaves")
    low, high, most = found.agg(F.min("id"), F.max("id"), F.max("n")).first()
    digits = id_digits(low, high)
    kinds = found.withColumns(digits)
    ids = written(kinds.groupBy("g", *digits).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")), "ids")
    spent += [found, ids]
    ranks = radix_starts(ids, ["g"], list(digits), spent).select("g", *digits, "start", "total")
    out = kinds.join(ranks, ["g", *digits])
    tied = ids.where("kinds > 1")
    if tied.limit(1).count():
        same = kinds.join(tied.select("g", *digits), ["g", *digits], "left_semi")
        further = {f"l{i}": F.substring("leaf", 1 + 3 * i, 3) for i in range(3)}
        within = radix_starts(same.withColumns(further), ["g", *digits], [*further, "leaf"], spent)
        within = within.select("g", *digits, "leaf", F.col("start").alias("within"))
        out = out.join(within, ["g", *digits, "leaf"], "left").withColumn("start", F.col("start") + F.coalesce("within", F.lit(0)))
    out = out.select("g", F.col("start").alias("pos"), F.col("total").alias("n"), "id", "leaf", "other", F.col("n").alias("copies"))
    if (most or 0) > 1:
        first = out.where("copies > 1").withColumn("at", F.explode(F.expr(f"sequence(0L, copies - 1, {COPIES}L)"))).repartition("g", "pos", "at")
        more = first.withColumn("at", F.explode(F.expr(f"sequence(at, least(at + {COPIES - 1}, copies - 1))"))).withColumn("pos", F.col("pos") + F.col("at")).drop("at")
        out = out.where("copies = 1").unionByName(more)
    return out.drop("copies")


def name_ranks(names: DataFrame, spent: list[DataFrame]) -> DataFrame:
    """(id, digest, pos, n): the place of each different string ``id`` in order of its bytes, by up to eight digits of its hexadecimal form."""
    longest = names.agg(F.max(F.octet_length("id"))).first()[0] or 1
    wide = 2 * max(2, -(-longest // 8))
    digits = {f"d{i}": F.substring(F.hex(F.col("id").cast("binary")), 1 + wide * i, wide) for i in range(-(-2 * longest // wide))}
    rows = names.withColumns(digits).withColumn("n", F.lit(1).cast("long"))
    found = radix_starts(rows, [], list(digits), spent).select(*digits, F.col("start").alias("pos"), "total")
    return rows.drop("n").join(found, list(digits)).select("id", "digest", "pos", F.col("total").alias("n"))


# -- trees


def levels_of(nodes: list[bytes], fanout: int, most: int | None) -> list[list[bytes]]:
    """Digests of a block, level above level: up to one node, or through ``most`` levels."""
    out = [nodes]
    while len(out[-1]) > 1 if most is None else len(out) <= most:
        last = out[-1]
        out.append([digest(*last[i : i + fanout]) for i in range(0, len(last), fanout)])
    return out


def block_levels(fanout: int) -> int:
    """Levels of a block: as many as keep it within ``BLOCK`` leaves, one at least."""
    out = 1
    while fanout ** (out + 1) <= BLOCK:
        out += 1
    return out


def dealt(nodes: DataFrame, block: int, *order: str) -> DataFrame:
    """Nodes by block, in order of their place; all that a block holds is in one task."""
    return nodes.withColumn("block", F.call_function("div", F.col("pos"), F.lit(block))).repartition("g", "block").sortWithinPartitions("g", "block", *order)


def raised(nodes: DataFrame, fanout: int) -> DataFrame:
    """The nodes (g, pos, n, digest) a block above."""
    high = block_levels(fanout)
    block = fanout**high

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (g, at), group in groupby(rows, key=lambda r: (r[0], r[4])):
            group = list(group)
            n = group[0][2]
            top = levels_of([r[3].encode() for r in group], fanout, high if n > block else None)[-1]
            yield g, at, -(-n // block), top[0].decode()

    return stream_rows(dealt(nodes.select("g", "pos", "n", "digest"), block, "pos"), work, NODE)


def pack_path(steps: Iterable[tuple[bytes, bytes]]) -> str:
    return b";".join(left + b"|" + right for left, right in steps).decode()


def unpack_path(path: str) -> list[tuple[bytes, bytes]]:
    return [tuple(step.split(b"|")) for step in path.encode().split(b";")] if path else []


def lowered(nodes: DataFrame, above: DataFrame, fanout: int, finish: Callable[[tuple, list, str | None, str], tuple], schema: str, *more: str) -> DataFrame:
    """What ``finish`` makes of each node: it sees the node's row, what stands beside its path, level by level to the root, the subroot and the root.

    ``above``: for each block (g, pos) the same, of the node that it became.  A row of a node is (g, pos, n, digest, more...).
    """
    high = block_levels(fanout)
    block = fanout**high
    kinds = dict(nodes.dtypes)
    own = nodes.select("g", "pos", "n", "digest", *more, *[F.lit(None).cast("string").alias(c) for c in ("above", "subroot", "root")], F.call_function("div", F.col("pos"), F.lit(block)).alias("block"))
    said = above.select("g", F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"), F.lit("").alias("digest"), *[F.lit(None).cast(kinds[c]).alias(c) for c in more], "above", "subroot", "root", F.col("pos").alias("block"))

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        for _, group in groupby(rows, key=lambda r: (r[0], r[-1])):
            head, *group = group
            path, subroot, root = head[-4:-1]
            n = group[0][2]
            levels = levels_of([r[3].encode() for r in group], fanout, high if n > block else None)
            beside = [unpack_path(path)]
            for level in reversed(levels[:-1]):
                steps = []
                for i in range(len(level)):
                    run = i - i % fanout
                    steps.append([(b"".join(level[run:i]), b"".join(level[i + 1 : run + fanout])), *beside[i // fanout]])
                beside = steps
            for r, steps in zip(group, beside):
                yield finish(r, steps, subroot, root)

    together = own.unionByName(said).repartition("g", "block").sortWithinPartitions("g", "block", "pos")
    return stream_rows(together, work, schema)


def as_path(row: tuple, steps: list, subroot: str | None, root: str) -> tuple:
    return row[0], row[1], pack_path(steps), subroot, root


def climbed(nodes: DataFrame, fanout: int, largest: int) -> list[DataFrame]:
    """The nodes, and those of each block level above, up to one for each group; what is above the leaves is written."""
    out, block = [nodes], fanout ** block_levels(fanout)
    while True:
        out.append(written(raised(out[-1], fanout), "nodes"))
        largest = -(-largest // block)
        if largest <= 1:
            return out


def manifest(leaves: DataFrame, fanout: int = 2) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of each leaf.

    ``leaves``: ``g`` (string, not null, the order of groups), ``id`` (long), ``leaf`` (hexadecimal digest), ``other``
    (the leaf to check, null: ``leaf``).  In a group, leaves ascend by id, null first, equal ids by
    digest; while nodes remain, every ``fanout`` consecutive ones become their digest; the subroots of groups
    likewise.  ``proof_sha256``: digest of the siblings from the leaf to the root; ``folded_root``: the root that
    ``other`` and those siblings give.  Repeated rows are leaves of their own; an empty table gives no row.
    """
    if fanout < 2:
        raise ValueError("the fanout must be 2 at least")
    spent: list[DataFrame] = []
    rows = written(placed(leaves, spent), "placed")
    largest = rows.agg(F.max("n")).first()[0]
    result = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if not largest:
        return leaves.sparkSession.createDataFrame([], result)
    trees = climbed(rows.withColumnRenamed("leaf", "digest"), fanout, largest)
    tops = written(name_ranks(trees[-1].select(F.col("g").alias("id"), "digest"), spent).withColumn("g", F.lit("")), "subroots")
    discard(*spent)
    crowns = climbed(tops, fanout, tops.count())
    above = crowns[-1].select("g", "pos", F.lit("").alias("above"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    for nodes in crowns[-2:0:-1]:
        above = lowered(nodes, above, fanout, as_path, PATH)
    # a subroot's path goes on under the name of its group, whose single node at the top it is
    above = lowered(tops, above, fanout, lambda r, steps, _, root: (r[4], 0, pack_path(steps), r[3], root), PATH, "id")
    for nodes in trees[-2:0:-1]:
        above = lowered(nodes, above, fanout, as_path, PATH)

    def finish(row: tuple, steps: list, subroot: str, root: str) -> tuple:
        node = (row[5] or row[3]).encode()
        for left, right in steps:
            node = digest(left, node, right)
        folded = node.decode()
        proof = digest(*[x for step in steps for x in step]).decode()
        return row[4], row[3], subroot, root, proof, folded, folded == root

    return lowered(trees[0], above, fanout, finish, result, "id", "other")


def document_leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Leaves of documents by lang; in rows that ``tampered`` selects, ``other`` is the leaf with one more in n_chars (a null stays).

    Nulls of any column are marked in the leaf; other columns are ignored.
    """
    head, tail = [F.col("doc_id"), F.col("source"), F.col("lang")], F.col("text")
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    other = F.when(tampered, leaf(*head, more, tail)) if tampered is not None else F.lit(None).cast("string")
    return docs.select(label(F.col("lang")).alias("g"), F.col("doc_id").cast("long").alias("id"), leaf(*head, F.col("n_chars"), tail).alias("leaf"), other.alias("other"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents; of every seventh by checksum of its id, a tampered leaf is checked.  See :func:`manifest` and :func:`document_leaves` for odd rows."""
    docs = table(spark, sf_dir, "documents")
    found = manifest(document_leaves(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0))
    return found.withColumnRenamed("id", "doc_id")
