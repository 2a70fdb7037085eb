"""Joins with declared cardinality, coalescing lookups, membership flags and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.contracts import ContractError, duplicate_keys
from tessera.operators.running import numbered


def guarded_left_join(left: DataFrame, right: DataFrame, on: Sequence[str], relation: str = "m:1") -> DataFrame:
    """Left join that fails if the right side (m:1), or either side (1:1), repeats a key."""
    sides = [right] if relation == "m:1" else [left, right]
    if any(duplicate_keys(s, on).limit(1).count() for s in sides):
        raise ContractError(f"the join on {', '.join(on)} is not {relation}")
    return left.join(right, list(on), "left")


def lookup_coalesce(left: DataFrame, right: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """`left` with the right side's value of each column where it has one."""
    named = right.select(*on, *(F.col(c).alias(f"_{c}") for c in columns))
    return left.join(named, list(on), "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*(f"_{c}" for c in columns))


def anti_union(base: DataFrame, others: DataFrame, on: Sequence[str], status: str) -> DataFrame:
    """`base` plus the rows of `others` that it lacks, with column status: `known` or the given word."""
    foreign = others.join(base.select(*on), list(on), "left_anti")
    return base.withColumn("status", F.lit("known")).unionByName(foreign.withColumn("status", F.lit(status)), allowMissingColumns=True)


def membership_flag(left: DataFrame, members: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """`left` plus boolean `name`: whether its key is in `members`."""
    return left.join(members.select(*on).distinct().withColumn("_in", F.lit(True)), list(on), "left").withColumn(name, F.coalesce("_in", F.lit(False))).drop("_in")


def symmetric_audit(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """(side, keys): keys on both sides, only left, only right."""
    a = left.select(F.col(on).alias("_k")).distinct().withColumn("_l", F.lit(1))
    b = right.select(F.col(on).alias("_k")).distinct().withColumn("_r", F.lit(1))
    side = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both")
    return a.join(b, "_k", "full").groupBy(side.alias("side")).agg(F.count("*").alias("keys"))


def optional_merge(base: DataFrame, other: DataFrame | None, on: Sequence[str], prefix: str, protected: Sequence[str] = ()) -> tuple[DataFrame, str]:
    """(`base` left-joined with `other`, status). Absent table, missing keys, nothing to add or repeated keys leave `base` as it is; clashing columns get the prefix, protected ones are skipped."""
    if other is None:
        return base, "absent"
    if any(k not in base.columns or k not in other.columns for k in on):
        return base, "missing_keys"
    new = [c for c in other.columns if c not in on and c not in protected]
    if not new:
        return base, "nothing_to_add"
    if duplicate_keys(other, on).limit(1).count():
        return base, "duplicate_keys"
    named = other.select(*on, *(F.col(c).alias(f"{prefix}{c}" if c in base.columns else c) for c in new))
    return base.join(named, list(on), "left"), "joined"


def covered_share(components: DataFrame, boxes: DataFrame, key: str, least: float = 0.5) -> DataFrame:
    """(key, components, matched, recall) of component boxes of which a proposed box of the key covers `least`; recall 1 without components."""
    zero = F.lit(0.0)
    c, b = components.alias("c"), boxes.alias("b")
    area = lambda r: F.greatest(zero, F.col(f"{r}.x1") - F.col(f"{r}.x0")) * F.greatest(zero, F.col(f"{r}.y1") - F.col(f"{r}.y0"))
    cut = F.greatest(zero, F.least("c.x1", "b.x1") - F.greatest("c.x0", "b.x0")) * F.greatest(zero, F.least("c.y1", "b.y1") - F.greatest("c.y0", "b.y0"))
    hit = c.join(b, F.col(f"c.{key}") == F.col(f"b.{key}"), "left").groupBy(F.col(f"c.{key}").alias(key), F.col("c.id").alias("id")).agg(F.max(F.coalesce(cut >= least * area("c"), F.lit(False))).alias("hit"))
    return hit.groupBy(key).agg(F.count("*").alias("components"), F.count_if("hit").alias("matched")).withColumn("recall", F.col("matched") / F.col("components"))


def either_key(left: DataFrame, right: DataFrame, ids: Sequence[str], keys: Sequence[str], right_key: str, columns: Sequence[str]) -> DataFrame:
    """`left` plus `columns` of the right row whose `right_key` equals the first of the left row's `keys` that finds one; matched_by names that key, null without any.

    `ids` tell the left rows apart, right keys must not repeat. Instead of an OR, which no equi-join can serve, the left keys are stacked with their priority,
    joined once by value, and the best hit of each row is kept: all by hash or sort, whatever the sizes. Existing columns of these names are replaced.
    """
    if duplicate_keys(right.filter(F.col(right_key).isNotNull()), [right_key]).limit(1).count():
        raise ContractError(f"{right_key} repeats")
    places = F.array(*(F.struct(F.lit(n).alias("place"), F.col(k).cast("string").alias("value")) for n, k in enumerate(keys)))
    stacked = left.select(*ids, F.explode(places).alias("_k")).select(*ids, F.col("_k.place").alias("_place"), F.col("_k.value").alias("_value")).filter("_value is not null")
    named = right.select(F.col(right_key).cast("string").alias("_value"), F.struct(*columns).alias("_found"))
    best = stacked.join(named, "_value").groupBy(*ids).agg(F.min_by("_found", "_place").alias("_found"), F.min("_place").alias("_place"))
    words = F.array(*map(F.lit, keys))
    return left.drop(*columns, "matched_by").join(best, list(ids), "left").withColumns({c: F.col(f"_found.{c}") for c in columns} | {"matched_by": F.get(words, F.col("_place"))}).drop("_found", "_place")


def by_position(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_ties: Sequence[str] = (), right_ties: Sequence[str] = ()) -> DataFrame:
    """The n-th row of `left` beside the n-th of `right`, plus position from 1; unequal counts are an error.

    Order is by a numeric key of each side, null first, then ties. Rows are numbered on two levels, over ranges of the key, so no task holds a side. Columns of the right
    side that the left has too get the ending `_right`.
    """
    a, b = left.count(), right.count()
    if a != b:
        raise ContractError(f"{a} rows beside {b}")
    clash = {c: f"{c}_right" for c in right.columns if c in left.columns}
    first, second = numbered(left, left_key, "position", left_ties), numbered(right, right_key, "position", right_ties)
    return first.join(second.withColumnsRenamed(clash), "position")


def zipped_lists(df: DataFrame, lists: Sequence[str], names: Sequence[str]) -> DataFrame:
    """A row for each place of a row's `lists`, plus place from 0 and an element of each list under `names`; lists of unequal lengths, or null beside one that isn't, are an error. Rows without places vanish."""
    sizes = [F.coalesce(F.size(c), F.lit(-1)) for c in lists]
    same = F.lit(True)
    for s in sizes[1:]:
        same = same & (s == sizes[0])
    zipped = F.arrays_zip(*(F.col(c).alias(n) for c, n in zip(lists, names, strict=True)))
    checked = F.when(same, zipped).otherwise(F.raise_error(F.concat(F.lit("lists of unequal lengths: "), F.concat_ws(", ", *(s.cast("string") for s in sizes)))))
    rest = [c for c in df.columns if c not in lists and c not in names and c != "place"]
    return df.select(*rest, F.posexplode(checked).alias("place", "_z")).select(*rest, "place", *(F.col("_z")[n].alias(n) for n in names))


def merge_if_counts_agree(base: DataFrame, other: DataFrame | None, on: Sequence[str]) -> tuple[DataFrame, str]:
    """(`base` left-joined with the other table's new columns, status): only if both have as many rows and the same keys once each; else `base` as it is.

    status: joined, absent, missing_keys, row_count_mismatch, duplicate_keys or nothing_to_add.
    """
    if other is not None and all(k in base.columns and k in other.columns for k in on) and base.count() != other.count():
        return base, "row_count_mismatch"
    return optional_merge(base, other, on, "other_", protected=[c for c in (other.columns if other is not None else []) if c in base.columns and c not in on])
