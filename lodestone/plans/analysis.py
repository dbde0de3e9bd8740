"""The analysis of a repository, from its files to stored tables, and back."""

from __future__ import annotations

import datetime
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, impact, resolve, retrieval, snapshots
from ..sources import corpus, git, parser
from ..sources.store import Store


def repository_id(url: str) -> str:
    return hashlib.sha256(url.encode()).hexdigest()[:16]


def analyze(spark: SparkSession, store: Store, url: str, root: str, commit: str | None = None, history: int = 100, with_git: bool = True) -> dict:
    """Scan, parse, resolve, measure and store a source tree.

    An unchanged commit with a complete snapshot is not analysed again. All node tables are made before any edges, so calls
    and imports may point to files that come later. Nothing of an earlier analysis goes before the new one has been computed.
    """
    repo = repository_id(url)
    now = datetime.datetime.now(datetime.timezone.utc)
    if with_git and commit is None:
        found = git.head(spark, root).first()
        commit = found["commit_hash"] if found else None
    if commit and store.exists("snapshots", repo) and not (with_git and git.dirty(root)):
        own = store.read("snapshots", repo)
        whole = snapshots.complete(own, of_snapshots(store, "snapshot_files", own), of_snapshots(store, "snapshot_patterns", own)).filter("complete")
        hit = own.filter(F.col("commit_hash") == commit).join(whole, "snapshot_id", "left_semi").first()
        if hit:
            return {"repo_id": repo, "snapshot_id": hit["snapshot_id"], "cached": True}
    if with_git and commit and not store.exists("commits", repo):
        import_history(spark, store, repo, root, history)
    scanned = corpus.scan(spark, root).cache()
    parsed = parser.parse(scanned).cache()
    mark = lambda df, **columns: df.withColumns({c: F.lit(v) for c, v in columns.items()})
    found = parser.tables(parsed)
    files = scanned.select("path", "language", "content_hash")
    edges = resolve.resolve_imports(files, found["imports"]).cache()
    nodes = graph.nodes(edges)
    metrics = impact.coupling_metrics(edges, files.select(F.col("path").alias("node"))).first()
    cycles = graph.count_cycles(edges).first()
    called = resolve.resolve_function_calls(found["function_calls"], found["functions"])
    texts = retrieval.embedding_text(parsed)
    terms = retrieval.dictionary(texts, "file")
    text = retrieval.embed(texts, terms, "file").select(F.concat_ws(":", F.lit(repo), "file").alias("id"), F.col("text").alias("code"), "embedding")

    snapshot = hashlib.sha256(f"{repo}_{now.isoformat()}".encode()).hexdigest()[:16]
    parts = {"snapshot_files": scanned.select("path", F.col("content_hash").alias("hash")), "snapshot_edges": edges, "snapshot_patterns": impact.detect_patterns(nodes, edges), "snapshot_coupling": impact.high_coupling(edges)}
    for name, table in parts.items():
        store.replace(name, snapshot, mark(table, snapshot_id=snapshot))
    row = (snapshot, repo, commit, now, metrics["total_files"], metrics["total_dependencies"], metrics["avg_coupling"], cycles["cycles"], cycles["truncated"])
    store.upsert("snapshots", spark.createDataFrame([row], "snapshot_id string, repo_id string, commit_hash string, created_at timestamp, total_files long, total_deps long, avg_coupling double, cycle_count long, cycles_truncated boolean"))
    if commit:
        store_commit(store, repo, commit, edges, spark.createDataFrame([row[4:]], "total_files long, total_deps long, avg_coupling double, cycle_count long, cycles_truncated boolean"))
        store.upsert("analysis_log", spark.createDataFrame([(repo, commit, now)], "repo_id string, commit_hash string, ts timestamp"))
    live = {"files": files, **found, "dep_edges": edges, "function_closure": closure(called), "code_chunks": text.filter("trim(code) <> ''"), "terms": terms}
    for name, table in live.items():
        store.replace(name, repo, mark(table, repo_id=repo))
    store.upsert("repositories", spark.createDataFrame([(repo, url.rstrip("/").rpartition("/")[2].removesuffix(".git"), url, root, commit, now)], "repo_id string, name string, url string, path string, current_commit string, last_analyzed timestamp"))
    for x in (scanned, parsed, edges):
        x.unpersist()
    return {"repo_id": repo, "snapshot_id": snapshot, "cached": False}


def closure(called: DataFrame, calls: int = 5) -> DataFrame:
    """(src, dst, dist): functions that a function reaches by up to ``calls`` calls (src, dst), and in how few."""
    back = called.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.dependents(back, called.select(F.col("src").alias("target")).distinct(), calls).select(F.col("target").alias("src"), F.col("node").alias("dst"), "dist")


def of_snapshots(store: Store, table: str, own: DataFrame) -> DataFrame:
    """The parts of a table that belong to these snapshots: a repository's list of them comes to the driver."""
    names = [r[0] for r in own.select("snapshot_id").collect()]
    return store.read(table, *names) if names else store.read(table).limit(0)


def store_commit(store: Store, repo: str, commit: str, edges: DataFrame, metrics: DataFrame) -> None:
    """A commit's dependencies and its row of metrics, in place of what was stored for it."""
    mark = lambda df: df.withColumns({"repo_id": F.lit(repo), "commit_hash": F.lit(commit)})
    store.delete("commit_edges", repo_id=repo, commit_hash=commit)
    store.upsert("commit_edges", mark(edges.select("src", "dst", "type")))
    store.upsert("commit_metrics", mark(metrics))


def commit_edges(store: Store, repo: str, commit: str) -> DataFrame:
    """(src, dst, type) of a commit."""
    return store.read("commit_edges", repo).filter(F.col("commit_hash") == commit).select("src", "dst", "type")


def commit_metrics(store: Store, repo: str, commit: str) -> DataFrame:
    """A commit's metrics: one row, or none."""
    return store.read("commit_metrics", repo).filter(F.col("commit_hash") == commit).drop("repo_id")


def import_history(spark: SparkSession, store: Store, repo: str, root: str, n: int = 100) -> int:
    """Commits and file versions of a repository's log; how many new versions there are."""
    log = git.log(spark, root, n).cache()
    store.upsert("commits", log.select(F.lit(repo).alias("repo_id"), F.col("hash").alias("commit_hash"), "message", F.timestamp_seconds("timestamp").alias("ts"), "author", "author_name"))
    store.upsert("users", log.select(F.col("author").alias("user_id"), F.col("author_name").alias("name")))
    new = store.append_new("file_versions", git.log(spark, root, n, git.GitBlobs).withColumn("repo_id", F.lit(repo)))
    log.unpersist()
    return new


def rebuild(store: Store, repo: str) -> dict[str, DataFrame]:
    """A repository's tables from the store; files and dependencies of its last snapshot where the analysis was cleared."""
    own = lambda t: store.read(t, repo).drop("repo_id")
    files, edges = own("files"), own("dep_edges")
    if files.isEmpty() and store.exists("snapshots", repo):
        last = own("snapshots").orderBy(F.desc("created_at"), "snapshot_id").first()
        if last:
            files = store.read("snapshot_files", last["snapshot_id"]).select("path", F.lit("unknown").alias("language"), F.col("hash").alias("content_hash"))
            edges = store.read("snapshot_edges", last["snapshot_id"])
    return {
        "files": files.select("path", "language", "content_hash"),
        "edges": edges.select("src", "dst", "type"),
        **{t: own(t) for t in ("classes", "functions", "imports", "file_calls", "function_calls")},
    }


def loaded(store: Store, repo: str) -> bool:
    """Whether there is an analysis of this repository."""
    return store.exists("repositories") and not store.read("repositories").filter(F.col("repo_id") == repo).isEmpty()
