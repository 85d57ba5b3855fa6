"""Connected components by alternating large-star and small-star rounds, each a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import discard, written


def _print(edges: DataFrame) -> tuple:
    """Count and order-free hash: equal for equal sets of edges."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst")), F.bit_xor(F.xxhash64("dst", "src"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (src, dst: long); component is the smallest node reachable.

    Nodes without an edge to another node are absent. A hub's rows are spread by the skew-split join
    between two written tables; only (src, dst) pairs move, and nothing but counts reaches the driver.
    Null ends and self-loops are ignored; no edges give no rows.
    """
    now = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    now = written(now, "edges")
    seen = _print(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = written(both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m")), "low")
        large = both.where("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        large = written(large, "large")
        discard(low, now)
        low = written(large.groupBy("src").agg(F.min("dst").alias("m")), "low")
        joined = large.join(low, "src")
        small = joined.select("src", F.col("m").alias("dst")).unionByName(joined.where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))).distinct()
        now = written(small, "small")
        discard(low, large)
        last, seen = seen, _print(now)
        if last == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
