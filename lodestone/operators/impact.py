"""Coupling, structural risk and the blast radius of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns, paths, rules
from ..shared import written
from . import graph

#: Bytes of callers' paths that go to all tasks; rows that get one list at once; rows that a task gets, as expected.
BROADCAST, SLICE, ROWS = 64 << 20, 256, 4096


def structural_risk(edges: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """(file, fan_in, fan_out, in_cycle, score, level)."""
    member = graph.components(edges).select("node", F.lit(True).alias("in_cycle"))
    found = graph.degrees(edges, every).join(member, "node", "left").withColumn("in_cycle", F.coalesce("in_cycle", F.lit(False)))
    scored = found.withColumn("score", rules.structural_score(F.col("fan_in"), F.col("fan_out"), F.col("in_cycle")))
    return scored.select(F.col("node").alias("file"), "fan_in", "fan_out", "in_cycle", "score", rules.structural_level(F.col("score")).alias("level"))


def risk_breakdown(risks: DataFrame) -> DataFrame:
    """``risks`` (fan_in, fan_out, in_cycle, ..) with the points that each part of the score gives, before it is capped."""
    bonus = lambda c: F.when(F.col(c) > 5, 10).otherwise(0).cast("long")
    return risks.withColumns(
        {
            "fan_in_pts": (8 * F.col("fan_in")).cast("long"),
            "fan_out_pts": (5 * F.col("fan_out")).cast("long"),
            "cycle_pts": F.when(F.col("in_cycle"), 30).otherwise(0).cast("long"),
            "high_fan_in_bonus": bonus("fan_in"),
            "high_fan_out_bonus": bonus("fan_out"),
        }
    )


def risk_of(risks: DataFrame, asked: DataFrame) -> DataFrame:
    """The risks of the files ``asked`` (file); unknown files have score 0 and level ``unknown``."""
    return asked.select("file").join(risks, "file", "left").select("file", F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("level", F.lit("unknown")).alias("level"))


def high_coupling(edges: DataFrame, threshold: int = 5) -> DataFrame:
    """(file, fan_in, fan_out, total, severity, fan_in_share) of the nodes with more edges than the threshold."""
    total = F.col("fan_in") + F.col("fan_out")
    found = graph.degrees(edges).withColumn("total", total).filter(F.col("total") > threshold)
    return found.select(F.col("node").alias("file"), "fan_in", "fan_out", "total", rules.coupling_severity(F.col("total")).alias("severity"), rules.share(F.col("fan_in"), F.col("total")).alias("fan_in_share"))


def coupling_metrics(edges: DataFrame, every: DataFrame) -> DataFrame:
    """One row (total_files, total_dependencies, avg_coupling, level, health) over nodes ``every`` (node) and the edges'."""
    n = every.select("node").unionByName(graph.nodes(edges)).distinct().agg(F.count("*").alias("total_files"))
    found = n.crossJoin(edges.agg(F.count("*").alias("total_dependencies")))
    found = found.withColumn("avg_coupling", F.round(F.col("total_dependencies") / F.greatest("total_files", F.lit(1)), 6))
    return found.select("*", rules.coupling_level(F.col("avg_coupling")).alias("level"), rules.health(F.col("avg_coupling")).alias("health"))


def directory_histogram(files: DataFrame, k: int | None = None) -> DataFrame:
    """(dir, n) of the files' parent directories, most files first; the ``k`` largest."""
    found = files.select(paths.parent(F.col("path")).alias("dir")).filter("dir IS NOT NULL").groupBy("dir").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dir")
    return found if k is None else found.limit(k)


def function_impact(functions: DataFrame, calls: DataFrame, separator: str | None = None) -> DataFrame:
    """(file, name, callers, n): other files that call each function of a file; ``calls`` as (file, callee).

    A name's callers are listed once, not for each of its functions, so no pairs are shuffled. With a ``separator`` lists come as texts.
    """
    asked = functions.select("file", "name").distinct().select(F.when(F.col("file").isNotNull(), F.col("name")).alias("key"), "file", F.struct("file", "name").alias("row"))
    each = functions.select(F.col("name").alias("key"), "name").distinct()
    return _with_callers(asked, each, calls, separator).select("row.file", "row.name", "callers", "n")


def _names(functions: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, names, functions): the names of each target's functions, sorted, and how many there are."""
    own = functions.select(F.col("file").alias("target"), "name").distinct().join(targets.select("target").distinct(), "target", "left_semi")
    return own.groupBy("target").agg(F.array_sort(F.collect_list("name")).alias("names"), F.count("*").alias("functions"))


def _each(named: DataFrame) -> DataFrame:
    """(names, name): each set of names once, with each of its names."""
    return named.select("names").distinct().select("names", F.explode("names").alias("name"))


def _count_callers(named: DataFrame, calls: DataFrame) -> DataFrame:
    """(target, callers): how many other files call a function of each target (target, names).

    Targets with the same names have the same callers but themselves, so files are counted once for each set of names: as
    bitmaps of numbered files for each name, put over each other. Pairs of targets and callers are never made.
    """
    each = _each(named)
    called = written(calls.select("file", F.col("callee").alias("name")).join(each.select("name").distinct(), "name", "left_semi"), "called")
    numbered = written(written(called.select("file").distinct(), "callers").withColumn("at", F.monotonically_increasing_id()), "callers")
    maps = called.join(numbered, "file").groupBy("name", F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("map"))
    merged = each.join(maps, "name").groupBy("names", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("map")).alias("n")).groupBy("names").agg(F.sum("n").alias("callers"))
    itself = named.select("target", F.explode("names").alias("name")).join(called.withColumnRenamed("file", "target"), ["target", "name"], "left_semi").select("target").distinct()
    found = named.join(merged, "names").join(itself.withColumn("own", F.lit(1)), "target", "left")
    return found.select("target", (F.col("callers") - F.coalesce("own", F.lit(0))).alias("callers"))


def blast_radius(edges: DataFrame, targets: DataFrame, functions: DataFrame, calls: DataFrame, kind: str = "modify") -> DataFrame:
    """(target, direct, indirect, total, functions, callers, level, score) of a change of each of ``targets`` (target).

    ``calls`` are (file, callee). Only the targets' functions and calls of these names are looked at, and callers are counted
    without a list of them.
    """
    reached = graph.dependents(edges, targets, 3).filter("node <> target")
    counted = reached.groupBy("target").agg(F.count_if(F.expr("dist = 1")).alias("direct"), F.count_if(F.expr("dist > 1")).alias("indirect"))
    named = written(_names(functions, targets), "names")
    names = named.select("target", "functions")
    callers = _count_callers(named, calls)
    found = targets.select("target").join(counted, "target", "left").join(names, "target", "left").join(callers, "target", "left").na.fill(0)
    risk = rules.change_risk(F.lit(kind), F.col("direct"), F.col("indirect"), F.col("callers"), F.col("functions"))
    return found.withColumn("risk", risk).select("target", "direct", "indirect", (F.col("direct") + F.col("indirect")).alias("total"), "functions", "callers", "risk.level", "risk.score")


def affected(edges: DataFrame, targets: DataFrame, functions: DataFrame, calls: DataFrame, separator: str | None = None) -> DataFrame:
    """(target, direct_dependents, indirect_dependents, functions_affected, function_callers): what :func:`blast_radius` counts, as sorted lists.

    One file's lists are as long as its counts say, which the graph bounds; a file without any has empty ones. Callers are
    listed once for each set of names that targets have. With a ``separator`` lists come as texts.
    """
    reached = graph.dependents(edges, targets, 3).filter("node <> target")
    listed = lambda c: F.array_sort(F.collect_list(c))
    files = reached.groupBy("target").agg(listed(F.when(F.col("dist") == 1, F.col("node"))).alias("direct_dependents"), listed(F.when(F.col("dist") > 1, F.col("node"))).alias("indirect_dependents"))
    named = written(_names(functions, targets), "names")
    sets = written(named.select("names").distinct().withColumn("key", F.monotonically_increasing_id()), "sets")
    found = targets.select("target").join(files, "target", "left").join(named.join(sets, "names").select("target", "key", F.col("names").alias("functions_affected")), "target", "left")
    rows = [F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("direct_dependents", "indirect_dependents", "functions_affected")]
    asked = found.select("key", F.col("target").alias("file"), F.struct("target", *rows).alias("row"))
    found = _with_callers(asked, sets.select("key", F.explode("names").alias("name")), calls, separator).select("row.*", F.col("callers").alias("function_callers"))
    return found if separator is None else found.select("target", *[F.array_join(c, separator).alias(c) for c in found.columns[1:-1]], "function_callers")


def _with_callers(asked: DataFrame, each: DataFrame, calls: DataFrame, separator: str | None) -> DataFrame:
    """(row, callers, n): each of ``asked`` (key, file, row) with the other files that call one of its key's names ``each`` (key, name), sorted, and their count.

    Up to BROADCAST bytes of callers' paths go to all tasks as one row; a key's callers are then bits, which become one list
    for up to SLICE rows at once. Beyond that the lists themselves are shuffled.
    """
    text = lambda c: c if separator is None else F.array_join(c, separator)
    called = written(calls.select("file", F.col("callee").alias("name")).filter("file IS NOT NULL"), "called")
    files = written(called.select("file").distinct(), "files")
    if (files.agg(F.sum(16 + F.octet_length("file"))).first()[0] or 0) > BROADCAST:
        by_name = called.groupBy("name").agg(F.collect_set("file").alias("files"))
        merged = each.join(by_name, "name").groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("files")))).alias("files"))
        found = asked.join(merged, "key", "left").select("row", F.coalesce(F.array_remove("files", F.col("file")), F.array().cast("array<string>")).alias("files"))
        return found.select("row", text(F.col("files")).alias("callers"), F.size("files").cast("long").alias("n"))
    every = written(files.agg(F.array_sort(F.collect_list("file")).alias("every")), "every")
    numbered = F.broadcast(every.select(F.posexplode("every").alias("at", "file")))
    blocks = F.broadcast(every.select(F.expr("transform(sequence(0, size(every) DIV 64), k -> slice(every, int(k * 64 + 1), 64))").alias("blocks")))
    words = called.join(numbered, "file").groupBy("name", F.expr("int(at DIV 64)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, at % 64))").alias("bits"))
    merged = written(each.join(words, "name").groupBy("key", "word").agg(F.bit_or("bits").alias("bits")), "merged")
    lists = merged.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words"), F.sum(F.bit_count("bits")).alias("n"))
    asked = written(asked, "asked")
    own = asked.select("key", "file").distinct().join(numbered, "file").withColumn("word", F.expr("int(at DIV 64)")).join(merged, ["key", "word"]).filter("getbit(bits, at % 64) = 1")
    size = asked.groupBy("key").agg(F.ceil(F.count("*") / SLICE).alias("slices"))
    marked = asked.join(size, "key", "left").join(own.select("key", "file", F.lit(True).alias("own")), ["key", "file"], "left")
    marked = written(marked.withColumn("slice", F.pmod(F.xxhash64("file"), "slices")), "marked")
    parts = max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-marked.count() // ROWS))
    listed = F.expr("flatten(transform(words, w -> filter(blocks[w.word], (f, i) -> getbit(w.bits, i) = 1)))")
    groups = marked.groupBy("key", "slice", "own").agg(F.collect_list(F.struct("file", "row")).alias("rows")).join(lists, "key").repartition(parts, "key", "slice", "own").crossJoin(blocks)
    together = groups.filter("own IS NULL").select("rows", text(listed).alias("callers"), "n").select(F.explode("rows").alias("r"), "callers", "n").select("r.row", "callers", "n")
    alone = groups.filter("own").select("rows", listed.alias("files"), "n").select(F.explode("rows").alias("r"), "files", "n")
    alone = alone.select("r.row", text(F.array_remove("files", F.col("r.file"))).alias("callers"), (F.col("n") - 1).alias("n"))
    rest = marked.join(lists.select("key"), "key", "left_anti").select("row", text(F.array().cast("array<string>")).alias("callers"), F.lit(0).cast("long").alias("n"))
    return together.unionByName(alone).unionByName(rest)


#: The classes of each pattern, in the order of n1, n2, n3; the class pairs of edges that count as its links.
_PATTERNS = {
    "layered": (patterns.LAYERED, ("presentation", "business", "data"), "(a.{p} = 'presentation' AND b.{p} = 'business') OR (a.{p} = 'business' AND b.{p} = 'data')"),
    "mvc": (patterns.MVC, ("controllers", "models", "views"), "a.{p} = 'controllers' AND b.{p} = 'models'"),
    "hexagonal": (patterns.HEXAGONAL, ("ports", "adapters", "domain"), "a.{p} = 'domain' AND coalesce(b.{p}, '') NOT IN ('domain', 'ports')"),
    "event_driven": (patterns.EVENTS, ("events", "publishers", "subscribers"), "FALSE"),
}


def detect_patterns(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A row for each pattern: (pattern, detected, confidence, n1, n2, n3, links).

    Nodes are classified for all patterns at once, and one pass over the edges with the classes of both ends counts all
    links. Those of a hexagonal architecture are the domain's edges to what is neither domain nor port; few of them mean
    that it is isolated.
    """
    classes = nodes.select("node", F.struct(*[patterns.classified(F.col("node"), c).alias(p) for p, (c, _, _) in _PATTERNS.items()]).alias("c"))
    ends = edges.join(classes.select(F.col("node").alias("src"), F.col("c").alias("a")), "src", "left").join(classes.select(F.col("node").alias("dst"), F.col("c").alias("b")), "dst", "left")
    links = ends.agg(*[F.count_if(F.expr(rule.format(p=p))).alias(f"{p}_links") for p, (_, _, rule) in _PATTERNS.items()])
    sizes = classes.agg(*[F.count_if(F.col(f"c.{p}") == x).alias(f"{p}_n{i}") for p, (_, names, _) in _PATTERNS.items() for i, x in enumerate(names, 1)])
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), *[F.col(f"{p}_{c}").alias(c) for c in ("n1", "n2", "n3", "links")]) for p in _PATTERNS]))
    rows = sizes.crossJoin(links).select(each.alias("r")).select("r.*")
    n1, n2, n3, linked = (F.col(c) > 0 for c in ("n1", "n2", "n3", "links"))
    layers = sum((c.cast("int") for c in (n1, n2, n3)), F.lit(0))
    pick = lambda **by: F.coalesce(*[F.when(F.col("pattern") == p, x) for p, x in by.items()])
    detected = pick(layered=layers == 3, mvc=n1 & n2, hexagonal=layers == 3, event_driven=n1 & (n2 | n3))
    sure = pick(
        layered=F.when((layers == 3) & linked, 0.85).when(layers == 3, 0.6).when(layers == 2, 0.5).otherwise(0.0),
        mvc=F.when(~(n1 & n2), 0.0).when((F.col("n3") >= 2) & linked, 0.9).when(linked, 0.75).otherwise(0.5),
        hexagonal=F.when(layers < 3, 0.0).when(F.col("links") * 10 < F.col("n3") * 3, 0.8).otherwise(0.5),
        event_driven=F.when(~(n1 & (n2 | n3)), 0.0).when(n2 & (F.col("n3") >= 2), 0.75).otherwise(0.5),
    )
    counted = F.when((F.col("pattern") != "layered") | (layers == 3), F.col("links")).otherwise(F.lit(0).cast("long"))
    return rows.select("pattern", detected.alias("detected"), sure.cast("double").alias("confidence"), "n1", "n2", "n3", counted.alias("links"))


def evidence(nodes: DataFrame, n: int = 5) -> DataFrame:
    """(pattern, files): the first ``n`` files that have a class in each pattern. Each task keeps no more than ``n`` of a pattern."""
    classes = F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), patterns.classified(F.col("node"), c).alias("class")) for p, (c, _, _) in _PATTERNS.items()]))
    found = nodes.select("node", classes.alias("c")).filter("c.class IS NOT NULL").select("c.pattern", "node").distinct()
    first = found.withColumn("rank", F.row_number().over(Window.partitionBy("pattern").orderBy("node"))).filter(F.col("rank") <= n)
    return first.groupBy("pattern").agg(F.array_sort(F.collect_list("node")).alias("files"))
