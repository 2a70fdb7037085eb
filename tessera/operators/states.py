"""Row state machines: ordered reasons, statuses and routes as expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import reasons


def with_status(df: DataFrame, rules: Sequence[tuple[Column, str]], good: str = "admitted", bad: str = "unresolved", column: str = "status") -> DataFrame:
    """`df` plus reason (texts of the failing rules joined by `;`) and the status they imply."""
    failed = reasons(rules)
    return df.withColumn("reason", F.concat_ws(";", failed)).withColumn(column, F.when(F.size(failed) == 0, good).otherwise(bad))


def route(rules: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The first route whose condition holds."""
    out = None
    for cond, name in rules:
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def labels(rules: Sequence[tuple[Column, str]], none: str = "ok") -> Column:
    """All labels whose condition holds joined by `|`; `none` for none."""
    joined = F.concat_ws("|", reasons(rules))
    return F.when(joined == "", none).otherwise(joined)
