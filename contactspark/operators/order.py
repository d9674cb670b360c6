"""Running sums, ranks and quantiles over a total order that no single task sees whole.

Rows are range-partitioned by the order; totals of the partitions give each its offset; sums run inside partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactspark.operators.tables import materialise


def running(rows: DataFrame, keys: list[str], order: list[str | Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with a column for each name in ``sums``: its sum over the rows before this one, in ``order``, within ``keys``.

    Rows that tie in the order follow each other in some order, so it should be total. Null keys are a group of their own.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = {name: f"__add_{name}" for name in sums}
    by = {f"__by_{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(order)}
    placed = rows.withColumns({names[k]: c for k, c in sums.items()} | by)
    # ranges are drawn from a sample: fixed once for both uses below
    placed = materialise(placed.repartitionByRange(n, *keys, *by).withColumn("__part", F.spark_partition_id()), "ordered")
    totals = placed.groupBy(*keys, "__part").agg(*[F.sum(names[k]).alias(f"__t_{k}") for k in sums])
    along = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = totals.select(*[F.col(k).alias(f"__key_{k}") for k in keys], F.col("__part").alias("__at"), *[F.coalesce(F.sum(f"__t_{k}").over(along), F.lit(0)).alias(f"__before_{k}") for k in sums])
    inside = Window.partitionBy(*keys, "__part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumns({k: F.coalesce(F.sum(names[k]).over(inside), F.lit(0)) for k in sums})
    on = [F.col("__part") == F.col("__at"), *[F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys]]
    out = out.join(offsets, on)  # a row for each partition and key
    return out.select(*rows.columns, *[(F.col(k) + F.col(f"__before_{k}")).alias(k) for k in sums])


def place(rows: DataFrame, keys: list[str], order: list[str | Column], name: str) -> DataFrame:
    """``rows`` with their place from 0 in a total order within ``keys``."""
    return running(rows, keys, order, {name: F.lit(1).cast("long")})


def tie_ranked(rows: DataFrame, keys: list[str], ranks: dict[str, str]) -> DataFrame:
    """``rows`` with a column of ranks for each {name: value column}: from 1 within ``keys``, equal values share their mean.

    Each distinct value is counted first, so a value that very many rows have is one row of the order.
    """
    for name, value in ranks.items():
        distinct = rows.groupBy(*keys, value).agg(F.count("*").alias("__n"))
        ranked = running(distinct, keys, [value], {"__below": F.col("__n")})
        ranked = ranked.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col(value).alias("__value"), (F.col("__below") + (F.col("__n") + 1) / F.lit(2.0)).alias(name))
        on = [F.col(value).eqNullSafe(F.col("__value")), *[F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]]
        rows = rows.join(ranked, on).drop("__value", *[f"__k_{k}" for k in keys])
    return rows


def quantiles(rows: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles of a column, interpolated between neighbours; nulls don't count; None for all if there are no values."""
    distinct = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("x")).agg(F.count("*").alias("n"))
    ranked = materialise(running(distinct, [], ["x"], {"below": F.col("n")}), "quantiles")
    n = ranked.agg(F.sum("n")).first()[0]
    if not n:
        return [None] * len(shares)
    at = sorted({p for s in shares for p in (math.floor(s * (n - 1)), math.ceil(s * (n - 1)))})
    holds = F.explode(F.filter(F.array(*map(F.lit, at)), lambda p: (p >= F.col("below")) & (p < F.col("below") + F.col("n"))))
    found = {r["p"]: r["x"] for r in ranked.select("x", holds.alias("p")).collect()}  # two rows for each share at most
    out = []
    for s in shares:
        low, high = found[math.floor(s * (n - 1))], found[math.ceil(s * (n - 1))]
        out.append(low + (high - low) * (s * (n - 1) - math.floor(s * (n - 1))))
    return out
