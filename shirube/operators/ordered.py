"""Running aggregates along an order, safe for a key that holds much of the table.

A plain window ships every row of a key to one task. Here each key is cut into buckets that
follow the order (a page, a day, a year). Rows are scanned inside (key, bucket), which is the only
large shuffle; one summary row per (key, bucket) is scanned along the buckets, and its carry is
joined back on the same (key, bucket) partitioning.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class Running:
    """Running sum of ``value`` up to the row (or to the row before it)."""
    value: Column
    inclusive: bool = True


@dataclass(frozen=True)
class Last:
    """Last non-null ``value`` up to the row (or to the row before it)."""
    value: Column
    inclusive: bool = True


def scan(df: DataFrame, keys: list[str], bucket: Column, order: list[str], outputs: dict[str, Running | Last]) -> DataFrame:
    """Add one column per output. ``bucket`` must not decrease along ``order`` within a key.

    ``order`` must be unique within a key, or rows that tie are scanned in no fixed order.
    """
    # One struct names key and bucket. Structs with equal null fields are equal, so the join back is a plain equality on the
    # column that the rows are already partitioned by, and they move once.
    staged = df.withColumn("_at", F.struct(*keys, bucket.alias("_bucket")))
    for name, spec in outputs.items():
        staged = staged.withColumn(f"_in_{name}", spec.value)
    position = F.struct(*[F.col(c) for c in order])

    totals = []
    for name, spec in outputs.items():
        value = F.col(f"_in_{name}")
        if isinstance(spec, Running):
            totals.append(F.sum(value).alias(f"_all_{name}"))
        else:
            totals.append(F.max_by(value, F.when(value.isNotNull(), position)).alias(f"_all_{name}"))
    part = lambda c: F.col("_at")[c]
    earlier = Window.partitionBy(*map(part, keys)).orderBy(part("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    carried = staged.groupBy("_at").agg(*totals)
    carry_cols = [
        (F.sum(f"_all_{name}").over(earlier) if isinstance(spec, Running)
         else F.last(f"_all_{name}", ignorenulls=True).over(earlier)).alias(f"_carry_{name}")
        for name, spec in outputs.items()
    ]
    carried = carried.select(F.col("_at").alias("_k_at"), *carry_cols)

    inside = Window.partitionBy("_at").orderBy(*order)
    scanned = staged
    for name, spec in outputs.items():
        frame = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow if spec.inclusive else -1)
        value = F.col(f"_in_{name}")
        local = F.sum(value).over(frame) if isinstance(spec, Running) else F.last(value, ignorenulls=True).over(frame)
        scanned = scanned.withColumn(f"_local_{name}", local)

    joined = scanned.join(carried, F.col("_at") == F.col("_k_at"), "left")
    results = []
    for name, spec in outputs.items():
        local, carry = F.col(f"_local_{name}"), F.col(f"_carry_{name}")
        if isinstance(spec, Running):
            results.append((F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))).alias(name))
        else:
            results.append(F.coalesce(local, carry).alias(name))
    return joined.select(*[F.col(c) for c in df.columns], *results)


def row_numbers(df: DataFrame, keys: list[str], bucket: Column, order: list[str], name: str) -> DataFrame:
    """1-based position of each row within its key."""
    return scan(df, keys, bucket, order, {name: Running(F.lit(1).cast("long"))})


def newest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by ``order``.

    Spark limits each task to one row per key before the shuffle, so a hot key stays small.
    """
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")
