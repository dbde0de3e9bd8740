"""Git repositories: logs and blobs as data sources whose partitions are commits; the state of a work tree by commands on the driver."""

from __future__ import annotations

import datetime
import hashlib
import shutil
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Seconds for a clone, for the log and for other commands.
CLONE, LOG, OTHER = 300, 30, 5
#: Starts a commit's line, and parts its fields; no subject can hold a NUL.
MARK, PART = "\x1e", "%x00"
#: Commits of a partition, and bytes of a blob that are held at once.
COMMITS, PIECE = 500, 1 << 20


def run(repo: str | Path, *args: str, timeout: int = OTHER) -> str:
    found = subprocess.run(["git", "-C", str(repo), *args], capture_output=True, timeout=timeout, check=True)
    return found.stdout.decode("utf-8", "replace")


def clone(url: str, workspace: str | Path, depth: int | None = 1) -> Path:
    """Clone into ``workspace`` under the repository's name, in place of what was there. ``depth`` None takes the whole history."""
    if not url or not url.strip():
        raise ValueError("no repository URL")
    target = Path(workspace) / url.strip().rstrip("/").rpartition("/")[2].removesuffix(".git")
    shutil.rmtree(target, ignore_errors=True)
    target.parent.mkdir(parents=True, exist_ok=True)
    if not shutil.which("git"):
        raise RuntimeError("git is not installed")
    done = subprocess.run(["git", "clone", "-q", *(["--depth", str(depth)] if depth else []), "--", url, str(target)], capture_output=True, text=True, timeout=CLONE)
    if done.returncode:
        raise RuntimeError(f"git clone failed: {done.stderr.strip()}")
    return target


def records(repo: str | Path, skip: int, n: int) -> list[str]:
    """The log's records from place ``skip`` on: a header and the files that the commit touches, in lines."""
    text = run(repo, "-c", "core.quotepath=off", "log", f"--skip={skip}", f"--max-count={n}", f"--format=%x1e%H{PART}%ae{PART}%an{PART}%at{PART}%s", "--name-only", timeout=LOG)
    return text.split(MARK)[1:]


def fields(record: str) -> tuple[str, str, str, int, str, list[str]]:
    """(hash, author, author_name, timestamp, message, files) of a record."""
    head, *names = record.split("\n")
    commit, author, name, at, message = head.split("\0")
    return commit, author, name, int(at), message, sorted({x for x in names if x})


def parse_log(log: DataFrame) -> DataFrame:
    """(hash, author, author_name, timestamp, message, files) of the records (record) of a log that was written down."""
    lines = F.split(F.ltrim("record", F.lit(MARK)), "\n")
    f = F.split(lines[0], "\0")
    files = F.array_sort(F.array_distinct(F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: x != "")))
    return log.filter(F.col("record") != "").select(f[0].alias("hash"), f[1].alias("author"), f[2].alias("author_name"), f[3].cast("long").alias("timestamp"), f[4].alias("message"), files.alias("files"))


class _Part(InputPartition):
    """Commits from a place in the log on."""

    def __init__(self, skip: int, n: int):
        self.skip, self.n = skip, n


class _Reader(DataSourceReader):
    """Reads a repository that executors see, some commits in each partition."""

    def __init__(self, options: dict):
        self.path, self.limit, self.each = options["path"], int(options.get("limit", 0)), int(options.get("commits", COMMITS))

    def partitions(self):
        every = int(run(self.path, "rev-list", "--count", "HEAD", timeout=LOG))
        n = min(every, self.limit) if self.limit else every
        return [_Part(a, min(self.each, n - a)) for a in range(0, n, self.each)] or [_Part(0, 0)]


class _LogReader(_Reader):
    def read(self, part):
        for i, record in enumerate(records(self.path, part.skip, part.n)):
            yield (part.skip + i, *fields(record))


class _BlobReader(_Reader):
    def read(self, part):
        with subprocess.Popen(["git", "-C", str(self.path), "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as process:
            for record in records(self.path, part.skip, part.n):
                commit, author, _, at, _, files = fields(record)
                for file in files:
                    process.stdin.write(f"{commit}:{file}\n".encode())
                    process.stdin.flush()
                    answer = process.stdout.readline().split()
                    if answer[-1] == b"missing":  # the commit deleted it
                        continue
                    digest, left = hashlib.sha256(), int(answer[-1])
                    while left:
                        data = process.stdout.read(min(left, PIECE))
                        digest.update(data)
                        left -= len(data)
                    process.stdout.read(1)
                    yield commit, file, digest.hexdigest(), datetime.datetime.fromtimestamp(at, datetime.timezone.utc), author


class GitLog(DataSource):
    """``spark.read.format("git_log").load(path)``: commits, newest first by n. Options: limit (0: all), commits (in a partition)."""

    @classmethod
    def name(cls):
        return "git_log"

    def schema(self):
        return "n long, hash string, author string, author_name string, timestamp long, message string, files array<string>"

    def reader(self, schema):
        return _LogReader(self.options)


class GitBlobs(GitLog):
    """``spark.read.format("git_blobs").load(path)``: the digest of each file in each commit that touches it, read and hashed where the partition is."""

    @classmethod
    def name(cls):
        return "git_blobs"

    def schema(self):
        return "commit_hash string, file_path string, hash string, ts timestamp, author string"

    def reader(self, schema):
        return _BlobReader(self.options)


def log(spark: SparkSession, repo: str | Path, n: int = 100, kind: type[DataSource] = GitLog) -> DataFrame:
    """The last ``n`` commits (0: all), or of kind :class:`GitBlobs` their files."""
    spark.dataSource.register(kind)
    return spark.read.format(kind.name()).option("limit", n).load(str(repo))


def head(spark: SparkSession, repo: str | Path) -> DataFrame:
    """The current commit as one row; none outside a repository."""
    try:
        own = run(repo, "log", "-1", f"--format=%H{PART}%ae{PART}%s{PART}%at{PART}%an").rstrip("\n").split("\x00")
        rows = [(own[0], own[1], own[2], int(own[3]), own[4])]
    except (subprocess.SubprocessError, OSError, IndexError):
        rows = []
    return spark.createDataFrame(rows, "commit_hash string, author_email string, message string, timestamp long, author_name string")


def dirty(repo: str | Path) -> bool:
    try:
        return bool(run(repo, "status", "--porcelain").strip())
    except (subprocess.SubprocessError, OSError):
        return False
