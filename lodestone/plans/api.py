"""One method for each question that a client asks; answers are tables."""

from __future__ import annotations

import threading
import uuid
from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import confidence, graph, impact, projections, resolve, retrieval, snapshots, versions
from ..sources import git, parser
from ..sources.store import Store
from . import analysis, reports

#: Descriptions that are kept in memory; the oldest go first.
TEXTS = 100


class Api:
    """All analyses in a store."""

    def __init__(self, spark: SparkSession, root: str, writer: reports.Writer | None = None):
        self.spark, self.store, self.writer = spark, Store(spark, root), writer
        self.jobs: dict[str, dict] = {}
        self.texts: OrderedDict[tuple[str, str | None], dict[str, str]] = OrderedDict()

    def _own(self, table: str, repo: str) -> DataFrame:
        return self.store.read(table, repo).drop("repo_id")

    # Analyses and their state.

    def analyze(self, url: str, workspace: str | None = None, root: str | None = None, wait: bool = True) -> str:
        """Analyse a repository, cloned to ``workspace`` or already at ``root``; the job's id. Without ``wait`` it goes on in a thread."""
        job = uuid.uuid4().hex
        self.jobs[job] = {"status": "processing"}

        def run():
            try:
                where = root or str(git.clone(url, workspace))
                self.jobs[job] = {"status": "completed", "result": analysis.analyze(self.spark, self.store, url, where)}
            except Exception as error:
                self.jobs[job] = {"status": "failed", "error": str(error)}

        if wait:
            run()
        else:
            threading.Thread(target=run, daemon=True).start()
        return job

    def status(self, job: str) -> dict:
        return self.jobs.get(job, {"status": "not_found"})

    def load(self, repo: str) -> bool:
        return analysis.loaded(self.store, repo)

    def import_git_history(self, repo: str, root: str, n: int = 100) -> int:
        return analysis.import_history(self.spark, self.store, repo, root, n)

    # Architecture.

    def _edges(self, repo: str) -> DataFrame:
        return analysis.rebuild(self.store, repo)["edges"]

    def architecture(self, repo: str) -> dict[str, str]:
        """The description of a repository's current commit: the one in memory, else the one that is stored, else a new one, which is stored."""
        commit = r["current_commit"] if (r := self._own_repository(repo).first()) else None
        if (repo, commit) in self.texts:
            return self.texts[repo, commit]
        found = None
        if commit and self.store.exists("architecture", repo):
            found = self._own("architecture", repo).filter((F.col("commit_hash") == commit) & (F.trim("macro") != "")).orderBy(F.desc("ts")).first()
        if found:
            text = {c: found[c] for c in ("macro", "meso", "micro")}
        else:
            text = self._described(repo)
            if commit and text["macro"].strip():
                row = self.spark.createDataFrame([(repo, commit, text["macro"], text["meso"], text["micro"])], "repo_id string, commit_hash string, macro string, meso string, micro string")
                self.store.upsert("architecture", row.withColumn("ts", F.current_timestamp()))
        self.texts[repo, commit] = text
        while len(self.texts) > TEXTS:
            self.texts.popitem(last=False)
        return text

    def _own_repository(self, repo: str) -> DataFrame:
        return self.store.read("repositories").filter(F.col("repo_id") == repo)

    def _described(self, repo: str) -> dict[str, str]:
        state = analysis.rebuild(self.store, repo)
        e, f = state["edges"], state["files"]
        return reports.architecture_report(reports.architecture_stats(f, e), reports.graph_context(f, e), [r["code"] for r in self._own("code_chunks", repo).orderBy("id").limit(reports.HITS).collect()], self.writer)

    def patterns(self, repo: str) -> DataFrame:
        e = self._edges(repo)
        return impact.detect_patterns(graph.nodes(e), e)

    def coupling(self, repo: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """(metrics, highly coupled files, cycles, how many cycles there are and whether longer ones are left out)"""
        state = analysis.rebuild(self.store, repo)
        counted = graph.count_cycles(state["edges"])
        return impact.coupling_metrics(state["edges"], state["files"].select(F.col("path").alias("node"))), impact.high_coupling(state["edges"]), graph.cycles(state["edges"]), counted

    def confidence_report(self, repo: str) -> tuple[DataFrame, DataFrame]:
        e = self._edges(repo)
        found = confidence.claims(self.patterns(repo), impact.high_coupling(e), graph.cycles(e, 5))
        return confidence.explained(found, impact.evidence(graph.nodes(e))), confidence.summary(found)

    # Files and functions.

    def resolve_path(self, repo: str, path: str) -> str:
        return projections.resolved_path(self.spark.createDataFrame([(path,)], "asked string"), self._own("files", repo)).first()["path"]

    def impact(self, repo: str, path: str, kind: str = "modify") -> DataFrame:
        """The blast radius of a change with lists of what it affects, its structural risk with the points of each part, and a sentence on it."""
        state, file = analysis.rebuild(self.store, repo), self.resolve_path(repo, path)
        target = self.spark.createDataFrame([(file,)], "target string")
        found = impact.blast_radius(state["edges"], target, state["functions"], state["file_calls"], kind)
        lists = impact.affected(state["edges"], target, state["functions"], state["file_calls"])
        risks = impact.risk_breakdown(impact.structural_risk(state["edges"], state["files"].select(F.col("path").alias("node"))))
        asked = target.select(F.col("target").alias("file"))
        parts = risks.drop("score", "level").withColumnRenamed("file", "target").join(target, "target", "left_semi")
        risk = impact.risk_of(risks, asked).select(F.col("file").alias("target"), F.col("score").alias("structural_score"), F.col("level").alias("structural_level"))
        return found.join(lists, "target").join(risk, "target").join(parts, "target", "left").withColumn("explanation", reports.impact_text(F.lit(kind), F.col("total"), F.col("level")))

    def dependencies(self, repo: str, path: str) -> DataFrame:
        return projections.dependencies_of(self.resolve_path(repo, path), self._own("imports", repo), self._edges(repo))

    def function(self, repo: str, name: str, content: DataFrame | None = None) -> DataFrame:
        """(name, file, line, callers, usage_count, related, code): a function's definitions.

        Callers are functions as ``file::name``, and other files for calls outside any function.
        Related are the ids of the nearest chunks. The code is there if ``content`` (path, content) is given.
        """
        state = analysis.rebuild(self.store, repo)
        calls = state["function_calls"].filter(F.col("callee") == name).select(F.col("callee").alias("name"), "file", "caller")
        by_file = state["file_calls"].filter(F.col("callee") == name).select(F.col("callee").alias("name"), "file")
        merged = resolve.merged_callers(calls.distinct(), by_file).select("name", F.col("file").alias("from"), F.concat_ws("::", "file", "caller").alias("caller"))
        own = state["functions"].filter(F.col("name") == name)
        used = F.array_sort(F.collect_set(F.when(F.col("caller").contains("::") | (F.col("from") != F.col("file")), F.col("caller"))))
        found = own.join(merged, "name", "left").groupBy("name", "file", "line").agg(used.alias("callers")).withColumn("usage_count", F.size("callers"))
        related = self.search(repo, name).agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("r")).select(F.slice("r.id", 1, reports.HITS).alias("related"))
        found = found.crossJoin(related)
        if content is None:
            return found
        return found.join(content.select(F.col("path").alias("file"), "content"), "file", "left").withColumn("code", parser.body(F.col("content"), F.col("line"))).drop("content")

    def search(self, repo: str, question: str, context: str | None = None) -> DataFrame:
        """The chunks nearest to a question, with those first that depend on the context file or that it depends on."""
        vector = retrieval.embed(self.spark.createDataFrame([("q", question)], "query_id string, text string"), self._own("terms", repo), "query_id").select("query_id", F.col("embedding").alias("vector"))
        hits = retrieval.search(self._own("code_chunks", repo), vector)
        if context is None:
            near = hits.select("query_id", "id").limit(0)
        else:
            file, e = self.resolve_path(repo, context), self._edges(repo)
            target = self.spark.createDataFrame([(file,)], "target string")
            files = graph.dependents(e, target, 3).select("node").union(e.filter(F.col("src") == file).select("dst"))
            near = files.select(F.lit("q").alias("query_id"), F.concat_ws(":", F.lit(repo), "node").alias("id"))
        return retrieval.merged(hits, near)

    def files(self, repo: str) -> DataFrame:
        return self._own("files", repo).select("path").orderBy("path")

    def debug_files(self, repo: str, text: str = "") -> DataFrame:
        return projections.matching_files(text, self._own("files", repo), self._own("imports", repo), self._edges(repo))

    def functions(self, repo: str) -> DataFrame:
        return self._own("functions", repo).select("name", "file", "line").orderBy("file", "line")

    def graph_data(self, repo: str) -> tuple[DataFrame, DataFrame]:
        state = analysis.rebuild(self.store, repo)
        return projections.file_graph(state["edges"].filter("type = 'imports'"), state["files"])

    def function_graph(self, repo: str) -> tuple[DataFrame, DataFrame]:
        state = analysis.rebuild(self.store, repo)
        return projections.function_graph(state["functions"], state["file_calls"], state["function_calls"])

    def function_closure(self, repo: str) -> DataFrame:
        """(src, dst, dist): functions that a function reaches by up to five calls."""
        return self._own("function_closure", repo)

    def call_chain(self, repo: str, name: str) -> DataFrame:
        state = analysis.rebuild(self.store, repo)
        named = state["functions"].filter(F.col("name") == name)
        return projections.call_chain(name, named, resolve.resolve_calls(state["file_calls"].filter(F.col("callee") == name), named))

    # Repositories, snapshots and history.

    def repositories(self) -> DataFrame:
        count = lambda t, c: self.store.read(t).groupBy("repo_id").agg(F.count("*").alias(c)) if self.store.exists(t) else self.spark.createDataFrame([], f"repo_id string, {c} long")
        return self.store.read("repositories").join(count("files", "file_count"), "repo_id", "left").join(count("snapshots", "version_count"), "repo_id", "left").na.fill(0, ["file_count", "version_count"]).orderBy(F.desc("last_analyzed"), "repo_id")

    def snapshots(self, repo: str) -> DataFrame:
        own = self.store.read("snapshots", repo)
        return snapshots.listing(own, analysis.of_snapshots(self.store, "snapshot_files", own)).orderBy(F.desc("ordinal"))

    def delete_snapshot(self, snapshot: str) -> int:
        for table in ("snapshot_files", "snapshot_edges", "snapshot_patterns", "snapshot_coupling"):
            self.store.delete(table, snapshot_id=snapshot)
        return self.store.delete("snapshots", snapshot_id=snapshot)

    def delete_repository(self, repo: str) -> int:
        return self.store.delete_repository(repo)

    def _of(self, table: str, *snapshots_: str) -> DataFrame:
        return self.store.read(table, *snapshots_)

    def compare_snapshots(self, first: str, second: str) -> DataFrame:
        """One row: counts and differences, up to 20 files of each kind, and what was written on both."""
        files = self._of("snapshot_files", first, second)
        found = snapshots.compare(self.store.read("snapshots"), files, first, second, self._of("snapshot_patterns", first, second), self._of("snapshot_coupling", first, second))
        return found.crossJoin(snapshots.changed_lists(files, first, second)).crossJoin(snapshots.described(self.store.read("snapshots"), self._texts(), first, second))

    def _texts(self, repo: str | None = None) -> DataFrame:
        if not self.store.exists("architecture"):
            return self.spark.createDataFrame([], "commit_hash string, macro string, ts timestamp")
        return self.store.read("architecture", *([] if repo is None else [repo])).select("commit_hash", "macro", "ts")

    def changed_files(self, first: str, second: str) -> DataFrame:
        return snapshots.file_diff(self._of("snapshot_files", first, second), first, second)

    def changed_edges(self, first: str, second: str) -> DataFrame:
        return snapshots.edge_diff(self._of("snapshot_edges", first), self._of("snapshot_edges", second))

    def changed_patterns(self, first: str, second: str) -> DataFrame:
        return snapshots.pattern_diff(self._of("snapshot_patterns", first), self._of("snapshot_patterns", second))

    def riskiest_changes(self, repo: str, first: str, second: str) -> DataFrame:
        """(file, score, level): of the files added or changed between two snapshots, those of most structural risk now."""
        state = analysis.rebuild(self.store, repo)
        risks = impact.structural_risk(state["edges"], state["files"].select(F.col("path").alias("node")).union(graph.nodes(state["edges"])).distinct())
        return snapshots.riskiest(risks, self.changed_files(first, second).filter("status <> 'removed'").select(F.col("path").alias("file")))

    def analysis_links(self, repo: str) -> DataFrame:
        """(commit_hash, previous): analysed commits and the one that was current before."""
        return versions.analysis_links(self.store.read("analysis_log", repo)).drop("repo_id")

    def commit_state(self, repo: str, commit: str) -> tuple[DataFrame, DataFrame]:
        """A commit's (dependencies, metrics), as they were when it was analysed."""
        return analysis.commit_edges(self.store, repo, commit), analysis.commit_metrics(self.store, repo, commit)

    def compare_architecture(self, repo: str, first: str, second: str) -> DataFrame:
        own = self.store.read("snapshots", repo)
        return snapshots.architecture_report(own, first, second, analysis.of_snapshots(self.store, "snapshot_patterns", own), self._texts(repo))

    def commits(self, repo: str) -> DataFrame:
        return versions.commits_listing(self._own("commits", repo), self._own("file_versions", repo))

    def commit_files(self, repo: str, commit: str) -> DataFrame:
        return versions.commit_files(self._own("file_versions", repo), commit)

    def compare_commits(self, repo: str, first: str, second: str) -> DataFrame:
        return versions.compare_commits(self._own("file_versions", repo), first, second)

    def versions(self, repo: str) -> DataFrame:
        return versions.versions_listing(self._own("file_versions", repo), self._own("commits", repo))

    def file_history(self, repo: str, path: str) -> DataFrame:
        own = self.store.read("file_versions", repo).filter(F.col("file_path").endswith(path))
        return versions.file_history(own).orderBy(F.desc("ts"), "hash")

    def contributors(self, repo: str) -> DataFrame:
        return versions.contributors(self._own("file_versions", repo))

    def check_integrity(self, repo: str, current: DataFrame) -> DataFrame:
        return versions.tampered(self.store.read("file_versions", repo), current.withColumn("repo_id", F.lit(repo))).drop("repo_id")
