"""Commits, file versions and their lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def commit_lineage(commits: DataFrame) -> DataFrame:
    """(repo_id, commit_hash, previous): consecutive commits of a repository by time."""
    order = Window.partitionBy("repo_id").orderBy("ts", "commit_hash")
    return commits.select("repo_id", "commit_hash", F.lag("commit_hash").over(order).alias("previous")).filter("previous IS NOT NULL")


def analysis_links(log: DataFrame) -> DataFrame:
    """(repo_id, commit_hash, previous): each analysed commit and the one that was current before it, where they differ. ``log``: (repo_id, commit_hash, ts)."""
    order = Window.partitionBy("repo_id").orderBy("ts", "commit_hash")
    return log.withColumn("previous", F.lag("commit_hash").over(order)).filter("previous <> commit_hash").select("repo_id", "commit_hash", "previous").distinct()


def file_history(versions: DataFrame) -> DataFrame:
    """The versions with the hash before them."""
    order = Window.partitionBy("repo_id", "file_path").orderBy("ts", "hash")
    return versions.withColumn("previous_hash", F.lag("hash").over(order))


def changed_versions(versions: DataFrame) -> DataFrame:
    """Versions whose hash differs from the one before."""
    return file_history(versions).filter("hash <> previous_hash")


def latest(versions: DataFrame) -> DataFrame:
    """(repo_id, file_path, hash, commit_hash, ts, author): each file's last version."""
    last = F.max(F.struct("ts", "hash", "commit_hash", "author")).alias("v")
    return versions.groupBy("repo_id", "file_path").agg(last).select("repo_id", "file_path", "v.hash", "v.commit_hash", "v.ts", "v.author")


def contributors(versions: DataFrame) -> DataFrame:
    """(author, files_modified, total_versions), most versions first."""
    return versions.groupBy("author").agg(F.countDistinct("file_path").alias("files_modified"), F.count("*").alias("total_versions")).orderBy(F.desc("total_versions"), "author")


def tampered(versions: DataFrame, current: DataFrame) -> DataFrame:
    """``current`` files ([repo_id], file_path, hash) with their status now: not_tracked, tampered or intact.

    Without a repository in ``current``, versions of all repositories count as one history.
    """
    key = ["repo_id", "file_path"] if "repo_id" in current.columns else ["file_path"]
    stored = versions.groupBy(*key).agg(F.max_by("hash", F.struct("ts", "hash")).alias("stored"))
    status = F.when(F.col("stored").isNull(), "not_tracked").when(F.col("stored").eqNullSafe(F.col("hash")), "intact").otherwise("tampered")
    return current.join(stored, key, "left").select(*key, status.alias("status"))


def new_versions(versions: DataFrame, scanned: DataFrame) -> DataFrame:
    """The scanned rows, with a hash and a commit, that are no version of their file yet."""
    key = ["repo_id", "file_path", "hash", "commit_hash"]
    return scanned.filter("hash IS NOT NULL AND hash <> '' AND commit_hash IS NOT NULL").join(versions.select(*key), key, "left_anti")


def commit_files(versions: DataFrame, commit: str) -> DataFrame:
    """(path, hash): the last version of each file in a commit."""
    return versions.filter(F.col("commit_hash") == commit).groupBy(F.col("file_path").alias("path")).agg(F.max_by("hash", F.struct("ts", "hash")).alias("hash"))


def compare_commits(versions: DataFrame, first: str, second: str, unchanged: bool = False) -> DataFrame:
    """(path, status) of the files of two commits: added, removed, modified, and unchanged if asked for."""
    a, b = commit_files(versions, first).withColumnRenamed("hash", "a"), commit_files(versions, second).withColumnRenamed("hash", "b")
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "modified").otherwise("unchanged")
    found = a.join(b, "path", "full_outer").select("path", status.alias("status"))
    return found if unchanged else found.filter("status <> 'unchanged'")


def commits_listing(commits: DataFrame, versions: DataFrame, n: int | None = None) -> DataFrame:
    """(commit_hash, message, author, ts, versions), newest first."""
    counted = versions.groupBy("commit_hash").agg(F.count("*").alias("versions"))
    found = commits.join(counted, "commit_hash", "left").select("commit_hash", "message", "author", "ts", F.coalesce("versions", F.lit(0)).alias("versions")).orderBy(F.desc("ts"), "commit_hash")
    return found if n is None else found.limit(n)


def versions_listing(versions: DataFrame, commits: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` newest versions with their commits' messages."""
    newest = versions.orderBy(F.desc("ts"), "file_path", "hash").limit(n)
    return newest.join(commits.select("commit_hash", "message"), "commit_hash", "left").select("file_path", "hash", "commit_hash", "author", "message")


def last_author(versions: DataFrame, commits: DataFrame) -> DataFrame:
    """(file_path, author, message) of each file's last version."""
    return latest(versions).join(commits.select("commit_hash", "message"), "commit_hash", "left").select("file_path", "author", "message")


def duplicate_keys(table: DataFrame, *key: str) -> DataFrame:
    """Keys that are there more than once, for tables whose keys should be unique."""
    return table.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
