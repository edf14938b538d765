"""Uploaded files: checks, hash and stored name as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BINARY = "path string, modificationTime timestamp, length long, content binary"


def filename(path: Column) -> Column:
    """The last part of a path, with safe characters and the ending .pdf."""
    base = F.regexp_replace(F.trim(F.element_at(F.split(path, "/"), -1)), "[^A-Za-z0-9._-]+", "-")
    return F.when(base == "", "document.pdf").when(F.lower(base).endswith(".pdf"), base).otherwise(F.concat(base, F.lit(".pdf")))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, content of the files. Spark's reader leaves files without bytes out."""
    return spark.read.format("binaryFile").schema(BINARY).load(folder)


#: Types that an upload may claim, besides none.
TYPES = ["application/pdf", "application/octet-stream"]


def register(files: DataFrame, limit_mb: float = 50, keep: list[str] | None = None) -> DataFrame:
    """path, sha256, stored_name and error (null if accepted) of files (path, length, content, maybe content_type), and the columns to keep."""
    sha = F.sha2("content", 256)
    claimed = F.col("content_type") if "content_type" in files.columns else F.lit(None).cast("string")
    error = (
        F.when(~F.lower("path").endswith(".pdf"), "extension")
        .when(claimed.isNotNull() & ~claimed.isin(TYPES), "type")
        .when(F.col("length") > limit_mb * 1024 * 1024, "size")
        .when(F.coalesce(F.substring("content", 1, 5) != F.encode(F.lit("%PDF-"), "UTF-8"), F.lit(True)), "content")
    )
    return files.select(*(keep or []), "path", sha.alias("sha256"), F.concat(F.substring(sha, 1, 12), F.lit("-"), filename(F.col("path"))).alias("stored_name"), error.alias("error"))


def new_only(registered: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row for each accepted content that the catalog lacks."""
    first = registered.filter("error is null").groupBy("sha256").agg(F.min_by(F.struct("path", "stored_name"), "path").alias("f"))
    return first.join(catalog.select("sha256"), "sha256", "left_anti").select("sha256", "f.*")
