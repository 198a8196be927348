"""Connected components by alternating large-star and small-star steps.

Each step is an aggregate of least neighbours, combined before its shuffle, and a join
whose hot keys adaptive execution splits.  Each round is a table in the shared folder, so
lineage stays short; the driver sees a count and a checksum of a round only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modeloom.llm.common import discard, written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(v, component), a written table: the least vertex of the component of each vertex of the edges (a, b); nulls and loops are left out."""
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    now, before = written(pairs, "edges"), None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("lo")).select("a", F.least("a", "lo").alias("lo"))
        large = both.join(least, "a").where("b > a").select(F.col("lo").alias("a"), "b").where("a < b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("lo"))
        met = large.join(least, "b")
        # both outputs of a neighbour come from one pass over the join
        out = met.select(F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("b").alias("b")), F.struct(F.col("lo").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").where("a < b").distinct()
        last, now = now, written(out, "edges")
        discard(last)
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    whole = now.select(F.col("b").alias("v"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("v"), F.col("a").alias("component")).distinct())
    out = written(whole, "components")
    discard(now)
    return out
