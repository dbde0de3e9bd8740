"""Source trees as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths


def scan(spark: SparkSession, root: str, extensions: list[str] | None = None) -> DataFrame:
    """(path, relative_path, language, content, content_hash) of the source files below ``root``, without excluded directories.

    The reader lists and filters by extension; any file system that Spark reads will do.
    """
    wanted = extensions or list(paths.LANGUAGES)
    pattern = "*{" + ",".join(wanted) + "}" if len(wanted) > 1 else f"*{wanted[0]}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    path = F.regexp_replace("path", r"^file:/+", "/")
    base = root.removeprefix("file://").rstrip("/")
    rows = raw.select(path.alias("path"), "content")
    relative = F.when(F.col("path").startswith(base + "/"), F.substring(F.col("path"), F.lit(len(base) + 2), F.length("path"))).otherwise(F.col("path"))
    return rows.filter(paths.included(F.col("path"))).select("path", relative.alias("relative_path"), paths.language(paths.extension(F.col("path"))).alias("language"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("content_hash"))


def repository_id(url) -> F.Column:
    return F.substring(F.sha2(url, 256), 1, 16)


def repository_name(url) -> F.Column:
    return F.regexp_replace(F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1), r"\.git$", "")
