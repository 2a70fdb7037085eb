"""Readers and writers for tables, nested JSON exports and text, with one notion of missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def missing_to_null(df: DataFrame) -> DataFrame:
    """NaN and blank text become null, text is trimmed: aggregates then skip them as they should."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            out[f.name] = F.nullif(F.trim(f.name), F.lit(""))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out[f.name] = F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType))
    return df.withColumns(out) if out else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header and a given schema: nothing is inferred, so the file is read once."""
    return missing_to_null(spark.read.schema(schema).csv(path, header=True, enforceSchema=False))


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = True) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=multi_line)


#: An annotation export: tasks with annotations with results.
ANNOTATIONS = """id bigint, file_upload string, data struct<image:string, release:string>, created_at string, updated_at string,
annotations array<struct<id:bigint, completed_by:string, created_at:string, updated_at:string, lead_time:double, parent_prediction:bigint,
  result:array<struct<id:string, from_name:string, to_name:string, type:string, original_width:int, original_height:int,
    value:struct<format:string, rle:array<int>, brushlabels:array<string>, choices:array<string>>>>>>"""


def explode_annotations(tasks: DataFrame) -> DataFrame:
    """A row for each result; a task or annotation without one keeps a row with status missing_annotation or missing_result."""
    one = tasks.select(F.col("id").alias("task_id"), F.col("data.image").alias("image"), F.col("created_at").alias("task_created_at"), F.col("updated_at").alias("task_updated_at"), F.explode_outer("annotations").alias("a"))
    each = one.select("task_id", "image", "task_created_at", "task_updated_at", F.col("a.id").alias("annotation_id"), F.col("a.completed_by").alias("grader"), F.col("a.updated_at").alias("annotation_updated_at"), F.explode_outer("a.result").alias("r"))
    status = F.when(F.col("annotation_id").isNull(), "missing_annotation").when(F.col("r").isNull(), "missing_result").otherwise("annotated")
    return each.select("*", status.alias("annotation_status"), F.col("r.from_name").alias("field"), F.col("r.value.choices")[0].alias("choice"), F.col("r.value.rle").alias("rle")).drop("r")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet in one commit; overwrites the path."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV parts with headers; arrays are joined by `|`."""
    flat = {f.name: F.array_join(F.col(f.name).cast("array<string>"), "|") for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)}
    (df.withColumns(flat) if flat else df).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
