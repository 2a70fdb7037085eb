"""Row contracts: every rule is one conditional count, all in a single aggregation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import is_missing


@dataclass(frozen=True)
class Rule:
    """`bad` marks the rows that break the rule."""

    name: str
    bad: Column


class ContractError(ValueError):
    """A table breaks its contract; the message names the rules and counts."""


def required(*columns: str) -> list[Rule]:
    return [Rule(f"missing_{c}", is_missing(F.col(c))) for c in columns]


def allowed(column: str, values: Sequence) -> Rule:
    return Rule(f"unsupported_{column}", F.col(column).isNotNull() & ~F.col(column).isin(*values))


def missing_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c not in df.columns]


def violations(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule, rows): how many rows break each rule, in rule order, from one pass."""
    counts = df.agg(*(F.count_if(F.coalesce(r.bad, F.lit(False))).alias(f"_{k}") for k, r in enumerate(rules)))
    rows = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.col(f"_{k}").alias("rows")) for k, r in enumerate(rules))))
    return counts.select(rows.alias("r")).select("r.rule", "r.rows")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def enforce(df: DataFrame, rules: Sequence[Rule] = (), unique: Sequence[str] = ()) -> DataFrame:
    """`df` itself if it holds; else ContractError. The only eager step of the library."""
    broken = [f"{r['rule']}: {r['rows']} rows" for r in violations(df, rules).filter("rows > 0").collect()] if rules else []
    if unique and duplicate_keys(df, unique).limit(1).count():
        broken.append(f"duplicate {', '.join(unique)}")
    if broken:
        raise ContractError("; ".join(broken))
    return df
