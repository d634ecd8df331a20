"""Joins on keys of which a few may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this part of all rows on, so fewer than SHARE keys are.
SHARE = 500
#: Parts that the rows of a hot key are dealt into.
SALTS = 64


def joined(rows: DataFrame, unique: DataFrame, key: str, by: str, total: int, counted: bool = False) -> DataFrame:
    """rows JOIN unique USING (key), with rows of hot keys dealt over many tasks by a hash of ``by``.

    ``unique`` has one row a key, and in ``n`` how many of the ``total`` rows
    have it; with ``counted`` the rows have the same ``n``. Otherwise the names
    of hot keys alone are broadcast, of which there are fewer than SHARE by
    count. Only hot keys' rows of ``unique`` are repeated, SALTS times.
    """
    often = F.col("n") > max(total // SHARE, SALTS)
    if counted:
        left, right = rows.withColumn("_hot", often), unique
    else:
        hot = F.broadcast(unique.filter(often).select(F.col(key).alias("_name"), F.lit(True).alias("_hot")))
        left, right = rows.join(hot, rows[key] == hot["_name"], "left").drop("_name"), unique
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(by, F.lit(11)), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    right = right.withColumn("_salt", F.explode(F.when(often, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.withColumn("_salt", salt).drop("_hot").join(right.drop("n") if counted else right, [key, "_salt"]).drop("_salt")
