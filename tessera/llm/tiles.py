"""Splits groups of any size into block pairs, so that comparing all members never gathers a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import written


def tiled(rows: DataFrame, group: list[str], id_col: str, block: int) -> DataFrame:
    """rows with t1 <= t2 (a pair of blocks of their group) and b (the row's own block, t1 or t2).

    A group of n rows has ceil(n / block) blocks; each row goes once to every pair that holds its block, so
    each pair of rows meets in exactly one tile and a tile holds about 2 * block rows whatever the group's size.
    Rows whose group is null must be filtered before. The join with the counts may be split when a group is hot.
    """
    counts = written(rows.groupBy(*group).agg(F.count("*").alias("__n")), "counts").where("__n > 1")
    n = F.ceil(F.col("__n") / F.lit(float(block))).cast("int")
    return (
        rows.join(counts, group)
        .withColumn("__blocks", n)
        .withColumn("b", F.pmod(F.xxhash64(id_col), F.col("__blocks").cast("long")).cast("int"))
        .withColumn("__j", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
        .withColumn("t1", F.least("b", "__j"))
        .withColumn("t2", F.greatest("b", "__j"))
        .drop("__n", "__blocks", "__j")
    )
