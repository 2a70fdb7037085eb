"""Scans that say where a row comes from, and why a line isn't one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.contracts import ContractError, duplicate_keys
from tessera.sources.files import missing_to_null

_BAD = "_corrupt_record"
#: Columns that may name the old stem, in order of preference.
LEGACY_COLUMNS = ("legacy_stem", "legacy_image_name", "legacy_filename", "legacy_path")


def scan(spark: SparkSession, path: str | Sequence[str], schema: str, kind: str | None = None) -> DataFrame:
    """The rows of csv, tsv or json files with a given schema, plus source_path, source_file and bad_line.

    The format is `kind`, or the path's suffix; another one is an error. A line that doesn't fit the schema, or holds two NUL characters, is a row with its text in bad_line and nulls. Nothing is inferred.
    """
    suffix = kind or str(path if isinstance(path, str) else path[0]).rpartition(".")[2].lower()
    wanted = T.StructType.fromDDL(schema)
    reader = spark.read.schema(T.StructType([*wanted.fields, T.StructField(_BAD, T.StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BAD).option("recursiveFileLookup", "true")
    if suffix in ("csv", "tsv"):
        found = reader.csv(path, header=True, sep="," if suffix == "csv" else "\t", enforceSchema=False)
    elif suffix == "json":
        found = reader.json(path)
    else:
        raise ValueError(f"unsupported file type: {suffix}")
    # a line is parsed as far as its columns are asked for: bad_line asks for all, so that no later choice of columns hides one
    every = F.concat_ws("", *(F.col(f"`{f.name}`").cast("string") for f in wanted.fields))
    bad = F.coalesce(F.col(_BAD), F.when(every.contains("\0\0"), every))
    with_source = found.select(*(F.col(f"`{f.name}`") for f in wanted.fields), F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_name").alias("source_file"), bad.alias("bad_line"))
    return missing_to_null(with_source)


def with_reasons(rows: DataFrame, required: Sequence[str]) -> DataFrame:
    """`rows` of scan() plus reason: unreadable_line, missing_<column> of the first required column that is null, or null for a good row."""
    reason = F.when(F.col("bad_line").isNotNull(), "unreadable_line")
    for c in required:
        reason = reason.when(F.col(c).isNull(), f"missing_{c}")
    return rows.withColumn("reason", reason)


def label(value: Column) -> Column:
    """A spreadsheet's label: trimmed, and whole numbers without their `.0`."""
    return F.regexp_replace(F.trim(value.cast("string")), r"^(\d+)\.0$", "$1")


def assignments(rows: DataFrame, sample: str, group: Column, date_in: str = r"(\d{4}-\d{2}-\d{2})") -> DataFrame:
    """(sample_id, source_date, assignment_group, source_file): who belongs to which group, of rows of scan().

    The date is the one in the file's path. Rows without a sample, or that couldn't be read, don't count; a sample that appears twice is an error.
    """
    date = F.regexp_extract("source_path", date_in, 1)
    out = rows.filter("bad_line is null").select(label(F.col(sample)).alias("sample_id"), F.nullif(date, F.lit("")).alias("source_date"), F.lower(F.trim(group)).alias("assignment_group"), "source_file").filter("sample_id <> ''")
    twice = duplicate_keys(out, ["sample_id"]).limit(10).collect()
    if twice:
        raise ContractError(f"duplicate sample ids: {sorted(r['sample_id'] for r in twice)}")
    return out


def stem_mapping(rows: DataFrame, target: str = "subject_image_id", mask_ending: str = "_mask") -> DataFrame:
    """(legacy_stem, target) of a mapping table: the first of LEGACY_COLUMNS that it has, as a file's stem less the mask ending. Equal rows count once; one stem with two targets is an error."""
    old = next((c for c in LEGACY_COLUMNS if c in rows.columns), None)
    if old is None or target not in rows.columns:
        raise ContractError(f"a mapping needs {target} and one of {', '.join(LEGACY_COLUMNS)}")
    stem = F.regexp_replace(F.regexp_replace(F.substring_index(F.col(old), "/", -1), r"(?<=.)\.[^.]*$", ""), f"{mask_ending}$", "")
    out = rows.filter(F.col(old).isNotNull()).select(stem.alias("legacy_stem"), F.col(target).cast("string").alias(target)).distinct()
    twice = duplicate_keys(out, ["legacy_stem"]).limit(10).collect()
    if twice:
        raise ContractError(f"duplicate mappings: {sorted(r['legacy_stem'] for r in twice)}")
    return out
