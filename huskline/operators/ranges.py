"""Total orders without a task that holds all rows: rows are dealt over ranges of their sort key, and what is counted within a range is moved by the totals of the ranges before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges, and rows of the sample for each, from which their bounds are taken.
PARTS, SAMPLED = 64, 64


def in_ranges(rows: DataFrame, key: dict[str, Column], parts: int = PARTS) -> DataFrame:
    """`rows` with the columns of `key`, by which they are sorted, and _part: the number of their range, in that order.

    Bounds are taken from a sample by hash of about `parts` * `SAMPLED` rows; they only say where ranges are cut.  Keys are not null.  A row's range depends
    on its key alone, so it is the same whenever a lost task is run again."""
    told = rows.withColumns(key)
    names = list(key)
    most = parts * SAMPLED
    total = told.count()
    chosen = told.select(*names) if total <= most else told.select(*names).where(F.pmod(F.xxhash64(*names), F.lit(1_000_000)) < int(1_000_000 * most / total) + 1)
    bounds = sorted(tuple(r) for r in chosen.limit(4 * most).collect())
    bounds = sorted({bounds[len(bounds) * i // parts] for i in range(1, parts)}) if bounds else []
    if not bounds:
        return told.withColumn("_part", F.lit(0))
    listed = F.array(*[F.struct(*[F.lit(v).cast(told.schema[n].dataType).alias(n) for n, v in zip(names, b)]) for b in bounds])
    return told.withColumn("_part", F.size(F.filter(listed, lambda b: b <= F.struct(*names))))


def moved(rows: DataFrame, *sums: str) -> DataFrame:
    """_part, before_<c> and all_<c> of each summed column: the total of the ranges before a range, and of all.  A row a range."""
    totals = rows.groupBy("_part").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    before, every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return totals.select("_part", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"before_{c}") for c in sums], *[F.sum(f"_{c}").over(every).alias(f"all_{c}") for c in sums])


def summed_before(rows: DataFrame, key: dict[str, Column], *sums: str, parts: int = PARTS) -> DataFrame:
    """`rows` with before_<c>, what c adds up to over all rows that come before in the order of `key`, and all_<c>."""
    dealt = in_ranges(rows, key, parts)
    within = Window.partitionBy("_part").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumns({f"_own_{c}": F.coalesce(F.sum(c).over(within), F.lit(0)) for c in sums})
    told = own.join(F.broadcast(moved(dealt, *sums)), "_part")
    return told.select(*rows.columns, *[(F.col(f"_own_{c}") + F.col(f"before_{c}")).alias(f"before_{c}") for c in sums], *[f"all_{c}" for c in sums])


def numbered(rows: DataFrame, key: dict[str, Column], parts: int = PARTS) -> DataFrame:
    """`rows` with place: their number from 1 in the order of `key`."""
    told = summed_before(rows.withColumn("_one", F.lit(1)), key, "_one", parts=parts)
    return told.withColumn("place", (F.col("before__one") + 1).cast("long")).drop("_one", "before__one", "all__one")
