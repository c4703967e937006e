"""Seeded order and top-n per group that hold when one group is most of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T


def seeded_key(id_col: Column, seed: int, method: str = "xxhash64") -> Column:
    """A pseudo-random order key that depends only on the id and the seed."""
    if method == "md5":
        return F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string")))
    return F.xxhash64(id_col, F.lit(seed))


def pick_index(id_col: Column, n, method: str = "xxhash64") -> Column:
    """0-based choice among ``n`` by hash of the id."""
    if method == "md5":
        head = F.substring(F.md5(id_col.cast("string")), 1, 8)
        return F.pmod(F.conv(head, 16, 10).cast("bigint"), n)
    return F.pmod(F.xxhash64(id_col), n)


def top_n_per_group(
    df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank",
    salts: int = 64, salt_on: list[str] | None = None,
) -> DataFrame:
    """First ``n`` rows of each group, ranked from 1.

    Up to the window limit Spark keeps the first ``n`` of each group on the map side, so a
    hot group shuffles at most ``n`` rows per task. Beyond it the groups are cut in ``salts``
    first by the hash of ``salt_on`` (every plain column unless given), so no task ever sorts a
    whole hot group.
    """
    if n > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        plain = [f.name for f in df.schema if isinstance(f.dataType, T.AtomicType)]
        salt = F.pmod(F.xxhash64(*(salt_on or plain)), F.lit(salts))
        inner = Window.partitionBy(*keys, "__salt").orderBy(*order)
        df = (
            df.withColumn("__salt", salt)
            .withColumn("__r", F.row_number().over(inner))
            .where(F.col("__r") <= n)
            .drop("__r", "__salt")
        )
    outer = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(outer)).where(F.col(rank) <= n)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key by ``order``, combined on the map side."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("__first")
    )
    return picked.select(*keys, *[F.col("__first")[c].alias(c) for c in rest])
