"""Column expressions that clean and parse identifiers, flags and free text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_missing(c: Column) -> Column:
    """Null, NaN or blank."""
    text = c.cast("string")
    return text.isNull() | (F.trim(text) == "") | (text == "NaN")


def clean(c: Column) -> Column:
    """Trimmed text, empty for what is missing."""
    return F.when(is_missing(c), F.lit("")).otherwise(F.trim(c.cast("string")))


def slug(c: Column) -> Column:
    """Lower case, runs of anything but letters a-z and digits as one underscore, none at the ends; `missing` if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(clean(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(bare == "", F.lit("missing")).otherwise(bare)


def joined_id(*parts: Column) -> Column:
    """Slugs joined by two underscores."""
    return F.concat_ws("__", *(slug(p) for p in parts))


def number(c: Column) -> Column:
    """Double, or null where the text is no number or NaN."""
    value = c.cast("string").try_cast("double")
    return F.when(~F.isnan(value), value)


def whole_label(c: Column) -> Column:
    """Text of a number, without the fraction where it is whole."""
    return F.when(c == F.floor(c), F.floor(c).cast("long").cast("string")).otherwise(c.cast("string"))


def letters_prefix(c: Column) -> Column:
    """Leading letters in upper case."""
    return F.upper(F.regexp_extract(F.trim(c), "^([A-Za-z]+)", 1))


def before_underscore(c: Column) -> Column:
    """What stands before the first underscore."""
    return F.substring_index(c, "_", 1)


def sheet_date(c: Column) -> Column:
    """MM-DD-YY as 20YY-MM-DD; other texts unchanged."""
    return F.regexp_replace(c, r"^(\d\d)-(\d\d)-(\d\d)$", "20$3-$1-$2")


def flag(c: Column, default: bool = False) -> Column:
    """Boolean from yes/no words; `default` for others."""
    word = F.lower(F.trim(c.cast("string")))
    return F.when(word.isin("true", "1", "yes", "y"), True).when(word.isin("false", "0", "no", "n"), False).otherwise(F.lit(default))


def reasons(rules: Sequence[tuple[Column, str]]) -> Column:
    """Array of the texts whose condition holds, in rule order."""
    return F.array_compact(F.array(*(F.when(cond, F.lit(text)) for cond, text in rules)))


def keyword_class(c: Column, classes: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """The first class one of whose keywords is in the text."""
    text, out = F.lower(F.coalesce(c, F.lit(""))), None
    for name, words in classes:
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(F.lit(default))


def proposed_score(c: Column) -> Column:
    """`a-b` as the mean of both, else the number, else null."""
    low, high = F.regexp_extract(c, r"^\s*([0-9.]+)\s*-\s*([0-9.]+)\s*$", 1), F.regexp_extract(c, r"^\s*([0-9.]+)\s*-\s*([0-9.]+)\s*$", 2)
    return F.when(low != "", (low.try_cast("double") + high.try_cast("double")) / 2).otherwise(number(c))


def without_suffix(c: Column, suffix: str) -> Column:
    """The text without a trailing suffix."""
    return F.when(c.endswith(suffix), F.left(c, F.length(c) - len(suffix))).otherwise(c)


def naming_format(stem: Column) -> Column:
    """canonical (`S1-2`), legacy (`S1_Image2`) or invalid."""
    return F.when(stem.rlike(r"^[A-Za-z0-9]+-[1-9]\d*$"), "canonical").when(stem.rlike(r"^[A-Za-z0-9]+_Image\d+$"), "legacy").otherwise("invalid")


def nearest_in(x: Column, values) -> Column:
    """Of sorted values the nearest to x; the smaller of equals."""
    return F.element_at(F.array_sort(F.transform(F.array(*(F.lit(float(v)) for v in values)), lambda s: F.struct(F.abs(x - s).alias("d"), s.alias("s")))), 1)["s"]
