"""Inventories of files: names, sizes and digests by the binary file source; images paired with their masks by stem."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.scratch import exists, qualified

#: Suffixes of image files.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".tif", ".tiff")


def local_folder(spark: SparkSession, root: str) -> str | None:
    """The folder that `root` names if it is one of the shared file system; None in other stores."""
    found = urlsplit(qualified(spark, root))
    return found.path if found.scheme == "file" else None


def write_texts(rows: DataFrame, root: str, keys: Sequence[str], value: str = "value") -> None:
    """A text file a distinct combination of `keys`, with its rows' values as lines, in folders key=value below `root`; keys are not null and plain words. The last key names the file, `key=value.txt`, or in other stores than
    file systems its folder, `key=value`: see `key_in_path`.

    Spark's writer makes, commits and renames every file with several calls of its store, on local file systems with a process each. Where `root` is a folder, tasks write
    the files themselves: under a name of their own first, so that a repeated task leaves the same files, and few folders are left to list. Other stores get Spark's writer.
    """
    dealt, folder = rows.select(*keys, value).repartition(*keys), local_folder(rows.sparkSession, root)
    if folder is None:
        dealt.write.partitionBy(*keys).text(root)
        return

    def put(at: tuple[str, ...], lines: list[str]) -> None:
        *folders, name = (f"{k}={v}" for k, v in zip(keys, at))
        below = os.path.join(folder, *folders)
        os.makedirs(below, exist_ok=True)
        own = os.path.join(below, f"_{uuid.uuid4().hex}")
        with open(own, "w", encoding="utf-8", newline="") as out:
            out.writelines(line + "\n" for line in lines)
        os.replace(own, os.path.join(below, f"{name}.txt"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, lines, files = None, [], 0
        for batch in batches:
            for *at, line in zip(*(batch.column(c).to_pylist() for c in (*keys, value))):
                if at != last:
                    if last is not None:
                        put(tuple(last), lines)
                        files += 1
                    last, lines = at, []
                lines.append(line)
        if last is not None:
            put(tuple(last), lines)
            files += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    os.makedirs(folder, exist_ok=True)
    dealt.sortWithinPartitions(*keys).mapInArrow(write, "files long").agg(F.sum("files")).collect()


def key_in_path(path: Column, key: str) -> Column:
    """A key's value in the path of a file of `write_texts`."""
    return F.regexp_extract(path, rf"(?:^|/){key}=([^/]*?)(?:\.txt)?(?:/|$)", 1)


def file_inventory(spark: SparkSession, root: str, glob: str | None = None, suffixes: Sequence[str] = (), digests: bool = True) -> DataFrame:
    """(path, folder, name, stem, suffix, bytes, modified, sha256) of the files below `root`, at any depth; path and folder are relative to it.

    suffix is lower-case with its dot. `glob` filters names before files are listed in detail, `suffixes` after. Without `digests` no content is read and sha256 is null.
    Hidden files (a leading dot or underscore) don't count, nor do empty ones, which Spark's readers skip. A root that isn't there gives no rows. Files are split among tasks and each is hashed as one
    value: files of 2 GB or more are an error of the reader.
    """
    wanted = "path string, folder string, name string, stem string, suffix string, bytes long, modified timestamp, sha256 string"
    if not exists(spark, root):
        return spark.createDataFrame([], wanted)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    path = F.expr(f"substring(path, {len(qualified(spark, root).rstrip('/')) + 2})")
    rows = found.select(path.alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), (F.sha2("content", 256) if digests else F.lit(None).cast("string")).alias("sha256"))
    named = rows.withColumns({"folder": F.regexp_replace("path", "/?[^/]*$", ""), "name": F.substring_index("path", "/", -1)})
    # a leading dot begins a name, not a suffix
    stem = F.when(F.col("name").rlike(r"^.+\.[^.]*$"), F.regexp_replace("name", r"\.[^.]*$", "")).otherwise(F.col("name"))
    out = named.withColumn("stem", stem).withColumn("suffix", F.lower(F.expr("substring(name, length(stem) + 1)")))
    out = out.filter(~F.col("name").startswith("._"))
    return (out.filter(F.col("suffix").isin(*suffixes)) if suffixes else out).select("path", "folder", "name", "stem", "suffix", "bytes", "modified", "sha256")


def first_by_stem(files: DataFrame, stem: Column, path: Column) -> DataFrame:
    """(stem, path, copies): the first path of each stem, and how many share it."""
    return files.groupBy(stem.alias("stem")).agg(F.min(path).alias("path"), F.count("*").alias("copies"))


def paired(files: DataFrame, kind: Column, subject: Column, stem: Column, path: Column, mask_ending: str = "_mask") -> DataFrame:
    """(subject, stem, image_path, mask_path, images, masks, status) of `files` of kind `images` and `masks`; other kinds don't count.

    A mask belongs to the image of its subject with its stem less `mask_ending`; a mask without that ending belongs to none. Of several files
    the first by path counts. status: matched_pair, missing_mask, orphan_mask, and duplicate_stem where several images share a stem.
    """
    rows = files.select(kind.alias("_kind"), subject.alias("subject"), stem.alias("_stem"), path.alias("_path")).filter("_kind in ('images', 'masks')")
    loose = (F.col("_kind") == "masks") & ~F.endswith(F.col("_stem"), F.lit(mask_ending))
    own = F.when((F.col("_kind") == "masks") & ~loose, F.expr(f"substring(_stem, 1, length(_stem) - {len(mask_ending)})")).otherwise(F.col("_stem"))
    is_image, is_mask = F.col("_kind") == "images", F.col("_kind") == "masks"
    per = rows.groupBy("subject", own.alias("stem"), loose.alias("_loose")).agg(
        F.min(F.when(is_image, F.col("_path"))).alias("image_path"), F.min(F.when(is_mask, F.col("_path"))).alias("mask_path"), F.count_if(is_image).alias("images"), F.count_if(is_mask).alias("masks")
    )
    status = F.when(F.col("images") > 1, "duplicate_stem").when(F.col("images") == 0, "orphan_mask").when(F.col("masks") == 0, "missing_mask").otherwise("matched_pair")
    return per.select("subject", "stem", "image_path", "mask_path", "images", "masks", status.alias("status"))


def unresolved(files: DataFrame, cohort: str, lane: str, surfaces: Sequence[str], **more: str) -> DataFrame:
    """Manifest rows of image files that no score is linked to yet."""
    fixed = {"join_status": "pending_discovery", "verification_status": "pending_discovery", "admission_status": "unresolved", "exclusion_reason": "missing_score_linkage"}
    return files.select(
        F.lit(cohort).alias("cohort_id"), F.col("path").alias("image_path"), F.lit(None).cast("double").alias("score"), F.col("name").alias("source_image_name"), F.col("stem").alias("source_sample_id"),
        F.lit(lane).alias("lane_assignment"), *(F.lit(v).alias(k) for k, v in (fixed | more).items()), F.lit(";".join(surfaces)).alias("discovery_surfaces"),
    )


def same_content(files: DataFrame) -> DataFrame:
    """(sha256, files, bytes, first_path): contents that several files have."""
    return files.filter("sha256 is not null").groupBy("sha256").agg(F.count("*").alias("files"), F.max("bytes").alias("bytes"), F.min("path").alias("first_path")).filter("files > 1")
