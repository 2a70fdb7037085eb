"""Row numbers and running totals over a whole table, without one task for all rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges of the leading key that a table is cut into.
BUCKETS = 128


def running_totals(df: DataFrame, key: str, totals: Mapping[str, Column], ties: Sequence[str] = (), descending: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """`df` plus, for each name, the sum of the column over the rows up to and including this one, by numeric `key` (null first), then `ties`.

    Rows are dealt into ranges of the key between approximate quantiles. Sums of the ranges (at most `buckets` + 1 rows) give
    each its start, and a window inside the range the rest: no task holds more than a range, unless one value of
    the key is a large part of the table.
    """
    edges = df.agg(F.percentile_approx(F.col(key).cast("double"), [k / buckets for k in range(1, buckets)], 10000)).first()[0] or []
    edges = F.array(*(F.lit(e) for e in sorted(set(edges)))).cast("array<double>")
    place = F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.size(F.filter(edges, lambda e: e < F.col(key).cast("double"))))
    dealt = df.withColumn("_range", place)
    sums = dealt.groupBy("_range").agg(*(F.sum(c).alias(f"_sum_{name}") for name, c in totals.items()))
    way = F.desc if descending else F.asc
    before = W.orderBy(way("_range")).rowsBetween(W.unboundedPreceding, -1)  # over a row a range
    starts = sums.select("_range", *(F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)).alias(f"_start_{name}") for name in totals))
    first = F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_first()
    inside = W.partitionBy("_range").orderBy(first, *ties).rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = dealt.join(F.broadcast(starts), "_range")
    return joined.withColumns({name: F.col(f"_start_{name}") + F.sum(c).over(inside) for name, c in totals.items()}).drop("_range", *(f"_start_{name}" for name in totals))


def numbered(df: DataFrame, key: str, name: str, ties: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """`df` plus bigint `name`: the row's number from 1 in the order of `key`, then `ties`."""
    return running_totals(df, key, {name: F.lit(1).cast("bigint")}, ties, descending)
