"""Snapshots of an analysis, and comparisons between two of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, rules


#: Files of each kind that a comparison lists, and characters of a summary (fixed values).
LISTED, SHORT = 20, 200


def listing(snapshots: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, snapshot_id, commit_hash, file_count, ordinal): the ordinal counts a repository's snapshots by commit."""
    counted = files.groupBy("snapshot_id").agg(F.countDistinct("path").alias("file_count"))
    order = Window.partitionBy("repo_id").orderBy("commit_hash", "snapshot_id")
    return snapshots.join(counted, "snapshot_id", "left").select("repo_id", "snapshot_id", "commit_hash", F.coalesce("file_count", F.lit(0)).alias("file_count"), F.row_number().over(order).alias("ordinal"))


def file_diff(files: DataFrame, first: str, second: str) -> DataFrame:
    """(path, status): added and removed canonical paths, and those whose hashes are both known and differ."""
    own = files.select("snapshot_id", paths.canonical(F.col("path")).alias("path"), "hash")
    side = lambda s, c: own.filter(F.col("snapshot_id") == s).groupBy("path").agg(F.max("hash").alias(c), F.lit(True).alias(f"in_{c}"))
    found = side(first, "a").join(side(second, "b"), "path", "full_outer")
    status = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(F.col("a") != F.col("b"), "modified")
    return found.select("path", status.alias("status")).filter("status IS NOT NULL")


def changed_lists(files: DataFrame, first: str, second: str, n: int = LISTED) -> DataFrame:
    """One row (files_added, files_removed, files_modified): the first ``n`` paths of each in order. Each task keeps no more than ``n`` of a kind."""
    order = Window.partitionBy("status").orderBy("path")
    few = file_diff(files, first, second).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return few.agg(*[F.array_sort(F.collect_list(F.when(F.col("status") == s, F.col("path")))).alias(f"files_{s}") for s in ("added", "removed", "modified")])


def edge_diff(first: DataFrame, second: DataFrame) -> DataFrame:
    """(src, dst, status): dependencies that only one of two edge tables has."""
    a, b = first.select("src", "dst"), second.select("src", "dst")
    return b.subtract(a).withColumn("status", F.lit("added")).unionByName(a.subtract(b).withColumn("status", F.lit("removed")))


def compare(snapshots: DataFrame, files: DataFrame, first: str, second: str, patterns: DataFrame | None = None, coupled: DataFrame | None = None) -> DataFrame:
    """One row: counts of changed files, differences of the metrics, pattern changes, risk areas, level and a summary. No row if a snapshot is missing.

    ``patterns`` (snapshot_id, pattern, detected, confidence) and ``coupled`` (snapshot_id, file), the highly coupled files, are
    what snapshots hold besides their metrics; without them there are none. Risk areas are more than 10 files added, an average
    coupling higher by more than 1, new cycles, and more highly coupled files.
    """
    counted = file_diff(files, first, second).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "modified")])
    side = lambda s, c: snapshots.filter(F.col("snapshot_id") == s).select(*[F.coalesce(x, F.lit(0)).alias(f"{c}_{x}") for x in ("total_files", "total_deps", "avg_coupling", "cycle_count")])
    both = side(first, "a").crossJoin(side(second, "b")).crossJoin(counted)
    delta = lambda x: F.col(f"b_{x}") - F.col(f"a_{x}")
    if coupled is None:
        both = both.withColumns({"high_coupling_before": F.lit(0).cast("long"), "high_coupling_after": F.lit(0).cast("long")})
    else:
        both = both.crossJoin(coupled.agg(F.count_if(F.col("snapshot_id") == first).alias("high_coupling_before"), F.count_if(F.col("snapshot_id") == second).alias("high_coupling_after")))
    if patterns is None:
        both = both.withColumn("pattern_changes", F.lit("").cast("string")).withColumn("changed_patterns", F.lit(0).cast("long"))
    else:
        own = lambda s: patterns.filter(F.col("snapshot_id") == s).select("pattern", "detected", "confidence")
        text = F.array_join(F.array_sort(F.collect_list(F.concat("pattern", F.lit(": "), "change"))), "; ")
        both = both.crossJoin(pattern_diff(own(first), own(second)).agg(text.alias("pattern_changes"), F.count("*").alias("changed_patterns")))
    both = both.select("added", "removed", "modified", F.round(delta("avg_coupling"), 2).alias("coupling_delta"), delta("cycle_count").alias("cycle_delta"), delta("total_deps").alias("dependency_delta"), delta("total_files").alias("file_delta"), "high_coupling_before", "high_coupling_after", "pattern_changes", "changed_patterns")
    more = F.col("high_coupling_after") - F.col("high_coupling_before")
    areas = sum((F.when(c, 1).otherwise(0) for c in (F.col("added") > 10, F.col("coupling_delta") > 1.0, F.col("cycle_delta") > 0, more > 0)), F.lit(0))
    said = F.concat_ws(
        "; ",
        F.when(F.col("added") > 10, F.concat(rules.signed(F.col("added")), F.lit(" files"))),
        F.when(F.col("coupling_delta") > 1.0, F.format_string("coupling %+.2f", "coupling_delta")),
        F.when(F.col("cycle_delta") > 0, F.concat(rules.signed(F.col("cycle_delta")), F.lit(" cycles"))),
        F.when(more > 0, F.concat(rules.signed(more), F.lit(" highly coupled files"))),
    )
    both = both.withColumn("risk_areas", areas).withColumn("risks", said)
    return both.withColumn("level", rules.level(F.col("risk_areas"), (3, "high"), (1, "medium"))).withColumn("summary", summary())


def summary() -> Column:
    """A sentence on the columns of :func:`compare`."""
    some = lambda c, text: F.when(F.col(c) > 0, F.format_string(text, F.col(c).cast("long")))
    said = F.concat_ws(
        "; ",
        some("added", "%d files added"),
        some("removed", "%d files removed"),
        some("modified", "%d files modified"),
        F.when(F.col("coupling_delta") > 0.5, "coupling increased").when(F.col("coupling_delta") < -0.5, "coupling decreased"),
        some("cycle_delta", "%d new cycles"),
        F.when(F.col("cycle_delta") < 0, F.format_string("%d cycles resolved", -F.col("cycle_delta").cast("long"))),
        some("changed_patterns", "%d pattern changes"),
    )
    return F.when(said == "", "No significant changes detected").otherwise(said)


def compare_architecture(snapshots: DataFrame, first: str, second: str) -> DataFrame:
    """One row of differences between the snapshots of two commits, found by their hash or else by its beginning."""

    def side(commit, c):
        hit = snapshots.filter(F.col("commit_hash").startswith(commit)).withColumn("rank", F.when(F.col("commit_hash") == commit, 0).otherwise(1))
        return hit.orderBy("rank", F.desc("commit_hash"), "snapshot_id").limit(1).select(F.col("commit_hash").alias(f"{c}_commit"), *[F.coalesce(x, F.lit(0)).alias(f"{c}_{x}") for x in ("total_files", "avg_coupling", "cycle_count")])

    both = side(first, "a").crossJoin(side(second, "b"))
    delta = lambda x: F.col(f"b_{x}") - F.col(f"a_{x}")
    both = both.select(F.col("a_commit").alias("before"), F.col("b_commit").alias("after"), F.round(delta("avg_coupling"), 2).alias("coupling_delta"), delta("cycle_count").alias("cycle_delta"), delta("total_files").alias("file_delta"))
    areas = sum((F.when(c, 1).otherwise(0) for c in (F.col("coupling_delta") > 1.0, F.col("cycle_delta") > 0, F.col("file_delta") > 20)), F.lit(0))
    return both.withColumn("risk_areas", areas).withColumn("level", rules.level(F.col("risk_areas"), (2, "high"), (1, "medium")))


def described(snapshots: DataFrame, architecture: DataFrame, first: str, second: str) -> DataFrame:
    """One row (architecture_before, architecture_after): what was written on the commits of two snapshots, ``Not cached`` where nothing was.

    ``architecture``: (commit_hash, macro, ts), of which the newest that says something counts.
    """
    said = architecture.filter(F.trim("macro") != "").groupBy("commit_hash").agg(F.max_by("macro", F.struct("ts", "macro")).alias("macro"))
    text = snapshots.filter(F.col("snapshot_id").isin(first, second)).join(said, "commit_hash", "left").select("snapshot_id", "macro")
    pick = lambda s: F.coalesce(F.max(F.when(F.col("snapshot_id") == s, F.col("macro"))), F.lit("Not cached"))
    return text.agg(pick(first).alias("architecture_before"), pick(second).alias("architecture_after"))


def architecture_report(snapshots: DataFrame, first: str, second: str, patterns: DataFrame, architecture: DataFrame) -> DataFrame:
    """One row: :func:`compare_architecture`, the pattern changes, the beginnings of both texts and a sentence; or just an error if a commit has no snapshot."""
    found = compare_architecture(snapshots, first, second)
    at = lambda c, side: found.select(F.col(c).alias("commit_hash")).join(snapshots, "commit_hash").orderBy("snapshot_id").limit(1).select(F.lit(side).alias("side"), "snapshot_id")
    own = patterns.join(F.broadcast(at("before", "a").unionByName(at("after", "b"))), "snapshot_id")
    changed = pattern_diff(*[own.filter(F.col("side") == s).select("pattern", "detected", "confidence") for s in "ab"])
    changes = changed.agg(F.array_join(F.array_sort(F.collect_list(F.concat("pattern", F.lit(": "), "change"))), "; ").alias("pattern_changes"), F.count("*").alias("changed_patterns"))
    said = architecture.filter(F.trim("macro") != "").groupBy("commit_hash").agg(F.max_by("macro", F.struct("ts", "macro")).alias("macro"))
    short = F.when(F.length("macro") > SHORT, F.concat(F.substring("macro", 1, SHORT), F.lit("..."))).otherwise(F.col("macro"))
    text = lambda c: said.select(F.col("commit_hash").alias(c), short.alias(f"summary_{c}"))
    whole = found.crossJoin(changes).join(text("before"), "before", "left").join(text("after"), "after", "left")
    sentence = F.format_string("%+d files, coupling %+.2f, %+d cycles, %d pattern changes", F.col("file_delta").cast("long"), F.col("coupling_delta").cast("double"), F.col("cycle_delta").cast("long"), "changed_patterns")
    whole = whole.withColumn("summary", sentence)
    asked = snapshots.sparkSession.createDataFrame([(f"no snapshots of the commits {first[:8]} and {second[:8]}",)], "missing string")
    out = asked.join(whole, F.lit(True), "left")
    return out.select(F.when(F.col("before").isNull(), F.col("missing")).alias("error"), *whole.columns)


def pattern_diff(first: DataFrame, second: DataFrame) -> DataFrame:
    """(pattern, change) between two tables (pattern, detected, confidence): newly detected, gone, or of another confidence."""
    a = first.select("pattern", F.col("detected").alias("da"), F.col("confidence").alias("ca"))
    b = second.select("pattern", F.col("detected").alias("db"), F.col("confidence").alias("cb"))
    both = a.join(b, "pattern", "full_outer").na.fill(False, ["da", "db"]).na.fill(0.0, ["ca", "cb"])
    step = F.round(F.col("cb") - F.col("ca"), 2)
    change = F.when(~F.col("da") & F.col("db"), "newly_detected").when(F.col("da") & ~F.col("db"), "no_longer_detected").when(F.col("da") & F.col("db") & (F.abs(step) > 0.1), F.concat(F.lit("confidence_changed: "), F.format_string("%+.2f", step)))
    return both.select("pattern", change.alias("change")).filter("change IS NOT NULL")


def complete(snapshots: DataFrame, files: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """(snapshot_id, complete): whether a snapshot has metrics, files and (where that table is given) patterns."""
    live = files.groupBy("snapshot_id").agg(F.count("*").alias("n"))
    whole = F.col("avg_coupling").isNotNull() & (F.coalesce("total_files", F.lit(0)) > 0) & (F.coalesce("n", F.lit(0)) > 0)
    rows = snapshots.join(live, "snapshot_id", "left")
    if patterns is not None:
        rows = rows.join(patterns.select("snapshot_id", F.lit(True).alias("described")).distinct(), "snapshot_id", "left")
        whole = whole & F.coalesce("described", F.lit(False))
    return rows.select("snapshot_id", whole.alias("complete"))


def cached(snapshots: DataFrame, files: DataFrame, repositories: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """The complete snapshots of their repositories' current commits."""
    whole = complete(snapshots, files, patterns).filter("complete").select("snapshot_id")
    now = repositories.select("repo_id", F.col("current_commit").alias("commit_hash"))
    return snapshots.join(whole, "snapshot_id", "left_semi").join(now, ["repo_id", "commit_hash"], "left_semi")


def preserved(files: DataFrame, already: DataFrame | None = None) -> DataFrame:
    """(snapshot_id, files): each snapshot's list as an array of (path, hash), for snapshots not in ``already``."""
    rows = files if already is None else files.join(already.select("snapshot_id"), "snapshot_id", "left_anti")
    return rows.groupBy("snapshot_id").agg(F.array_sort(F.collect_list(F.struct("path", "hash"))).alias("files"))


def riskiest(risks: DataFrame, files: DataFrame, looked: int = 30, n: int = 10) -> DataFrame:
    """(file, score, level) of the first ``looked`` changed files (file): the ``n`` of most risk, none without any.

    A file that isn't among the risks goes by the first file of its name.
    """
    few = files.select("file").orderBy("file").limit(looked).withColumn("name", paths.name(F.col("file")))
    known = risks.withColumn("name", paths.name(F.col("file"))).join(F.broadcast(few.select("name").distinct()), "name", "left_semi")
    met = F.broadcast(few).join(known.select("name", F.col("file").alias("own"), "score", "level"), "name")
    best = met.groupBy("file").agg(F.min_by(F.struct("score", "level"), F.struct(F.col("own") != F.col("file"), "own")).alias("r"))
    return best.select("file", "r.score", "r.level").filter("score > 0").orderBy(F.desc("score"), "file").limit(n)
