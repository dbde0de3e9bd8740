"""Texts about analyses. They are made by templates, so they are the same every time; a callable may write prose instead."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import graph, impact

Writer = Callable[[str], str]
#: Characters of evidence that a prompt shows of each hit, and hits and names at most (fixed values).
SHOWN, HITS, NAMES = 200, 3, 10


def impact_text(kind: Column, total: Column, level: Column) -> Column:
    """What a change does, in one sentence."""
    return F.format_string("%s: Affects %d files with %s risk.", F.upper(kind), total.cast("long"), level)


def architecture_stats(files: DataFrame, edges: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """One row (total_files, total_dependencies, avg_coupling, cycles, cycles_truncated, patterns, top_directories); from ``snapshot``'s metrics where there are no files."""
    every = files.select(F.col("path").alias("node"))
    found = impact.detect_patterns(graph.nodes(edges), edges).filter("detected").agg(F.array_join(F.array_sort(F.collect_list("pattern")), ", ").alias("patterns"))
    top = impact.directory_histogram(files, 8).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "dir"))), lambda x: F.format_string("%s (%d)", x["dir"], -x["n"])), ", ").alias("top_directories"))
    row = impact.coupling_metrics(edges, every).select("total_files", "total_dependencies", F.round("avg_coupling", 2).alias("avg_coupling"))
    row = row.crossJoin(graph.count_cycles(edges).withColumnRenamed("truncated", "cycles_truncated")).crossJoin(found).crossJoin(top)
    if snapshot is None:
        return row
    old = snapshot.limit(1).select(F.col("total_files").alias("f"), F.col("total_deps").alias("d"), F.col("avg_coupling").alias("a"), F.col("cycle_count").alias("c"), (F.col("cycles_truncated") if "cycles_truncated" in snapshot.columns else F.lit(None).cast("boolean")).alias("t"))
    gone = F.col("total_files") == 0
    either = lambda new, o: F.when(gone, F.coalesce(o, new)).otherwise(F.col(new)).alias(new)
    return row.join(old, F.lit(True), "left").select(either("total_files", F.col("f")), either("total_dependencies", F.col("d")), either("avg_coupling", F.col("a")), either("cycles", F.col("c")), either("cycles_truncated", F.col("t")), "patterns", "top_directories")


def graph_context(files: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (text): the graph in a few lines."""
    n = files.agg(F.count("*").alias("files")).crossJoin(edges.agg(F.count("*").alias("edges")))
    top = impact.directory_histogram(files, 10).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "dir"))).alias("t"))
    lines = F.array_join(F.transform("t", lambda x: F.format_string("- %s: %d files", x["dir"], -x["n"])), "\n")
    return n.crossJoin(top).select(F.concat_ws("\n", F.format_string("Files: %d", "files"), F.format_string("Dependencies: %d", "edges"), F.lit("Directories:"), lines).alias("text"))


def architecture_prompt(stats: str, context: str, evidence: list[str]) -> str:
    shown = "\n".join(f"- {x[:SHOWN]}" for x in evidence[:HITS])
    return f"Describe this architecture at three levels, each under its own heading (MACRO, MESO, MICRO).\n\n{stats}\n\n{context}\n\nExcerpts:\n{shown}"


def impact_prompt(path: str, kind: str, level: str, direct: list[str], functions: list[str]) -> str:
    return f"Explain what happens on: {kind} {path} (risk: {level}).\nDirect dependents: {', '.join(direct[:NAMES]) or 'none'}\nFunctions: {', '.join(functions[:NAMES]) or 'none'}"


def function_prompt(name: str, file: str, code: str, callers: list[str]) -> str:
    return f"Explain the function {name} of {file}.\n\n{code}\n\nCalled by: {', '.join(callers[:NAMES]) or 'nothing'}"


def pattern_lines(patterns: list[dict]) -> str:
    return "\n".join(f"- {p['pattern']}: confidence {p['confidence']:.2f}" for p in patterns if p["detected"]) or "- none"


def sections(text: str) -> dict[str, str]:
    """The parts of a text under its headings MACRO, MESO and MICRO; without headings all of it is the first."""
    parts = re.split(r"(?im)^\W*(macro|meso|micro)\b[^\n]*$", text)
    found = {parts[i].lower(): parts[i + 1].strip() for i in range(1, len(parts) - 1, 2)}
    return {k: found.get(k, text.strip() if k == "macro" and not found else "") for k in ("macro", "meso", "micro")}


def architecture_report(stats: DataFrame, context: DataFrame, evidence: list[str], writer: Writer | None = None) -> dict[str, str]:
    """Three sections; by ``writer`` from a prompt, else from the figures."""
    s, c = stats.first(), context.first()["text"]
    figures = f"{s['total_files']} files with {s['total_dependencies']} dependencies (average {s['avg_coupling']:.2f}, {s['cycles']} cycles{' of up to %d files' % graph.LONGEST if s['cycles_truncated'] else ''}). Patterns: {s['patterns'] or 'none'}."
    if writer is not None:
        return sections(writer(architecture_prompt(figures, c, evidence)))
    return {"macro": figures, "meso": f"Directories: {s['top_directories'] or 'none'}.", "micro": c}
