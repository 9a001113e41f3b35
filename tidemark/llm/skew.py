"""A join that frequent keys don't send to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 1000


def spread_join(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", share: int = SHARE) -> DataFrame:
    """rows joined (inner or left) with table, which has one row for each key at most.

    Keys that more than one in `share` rows have are fewer than `share`, so their part of the table is broadcast and their rows stay where they are; all
    others are shuffled, and none of them has more than that part of the rows. rows are read three times, so they should be a stored table. Null keys
    meet nothing; left keeps them.
    """
    total = rows.count()
    often = rows.groupBy(key).agg(F.count("*").alias("__n")).where((F.col("__n") * share > total) & F.col(key).isNotNull()).select(key)
    often = F.broadcast(often.join(table, key, how))
    rest = rows.join(often.select(key), key, "left_anti").join(table, key, how)
    return rows.join(often, key).unionByName(rest)
