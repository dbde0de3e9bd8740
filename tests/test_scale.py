"""Jobs whose pairs would outgrow their input: results, and that no step makes or shuffles the pairs."""

import pytest
from pyspark.sql import functions as F

from lodestone import shared
from lodestone.operators import graph, impact, projections, resolve, retrieval
from lodestone.sources import fixtures

N = 150


def rows_made(df, name=""):
    """The most rows that any operator (with a name like ``name``) of the run plan gave out."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(plan.plan())
        metrics = plan.metrics()
        for key in ("numOutputRows", "shuffleRecordsWritten"):
            if name in kind and metrics.contains(key):
                most = max(most, metrics.apply(key).value())
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]
    return most


def bytes_shuffled(df):
    """The shuffled bytes of all exchanges of the run plan."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(plan.plan())
        if plan.metrics().contains("shuffleBytesWritten"):
            total += plan.metrics().apply("shuffleBytesWritten").value()
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


@pytest.fixture(scope="module")
def calls(spark):
    """N files that define f and call it, and one name that nobody calls."""
    functions = spark.createDataFrame([(n, f"{i}.py", 1) for i in range(N) for n in ("f", "g")], "name string, file string, line int")
    called = spark.createDataFrame([(f"{i}.py", "f") for i in range(N)] + [("x.py", "f")], "file string, callee string")
    edges = spark.createDataFrame([("1.py", "0.py")], "src string, dst string")
    return functions, called, edges, functions.select(functions.file.alias("target")).distinct()


def test_callers_are_counted_without_pairs(calls):
    functions, called, edges, targets = calls
    found = impact.blast_radius(edges, targets, functions, called)
    assert rows_made(found) <= 10 * N
    assert {tuple(r)[4:6] for r in found.collect()} == {(2, N)}


def test_callers_are_listed_once_for_equal_names(calls):
    functions, called, edges, targets = calls
    found = impact.affected(edges, targets, functions, called)
    assert rows_made(found) <= 10 * N
    for r in found.collect():
        assert r["functions_affected"] == ["f", "g"] and r["function_callers"] == sorted({f"{i}.py" for i in range(N)} - {r["target"]} | {"x.py"})


def test_callers_of_many_names_are_not_shuffled_as_lists(spark, monkeypatch):
    """Each of 40 targets has two names of its own, each with the same 300 callers: 24,000 paths in lists, a tenth of that in bits."""
    callers = [f"{'long' * 20}/{i}.py" for i in range(300)]
    functions = spark.createDataFrame([(f"{k}{i}", f"t{i}.py", 1) for i in range(40) for k in "fg"], "name string, file string, line int")
    called = spark.createDataFrame([(c, f"{k}{i}") for i in range(40) for k in "fg" for c in callers] + [("t3.py", "f3"), (None, "f3"), ("x.py", None)], "file string, callee string")
    edges = spark.createDataFrame([("t1.py", "t0.py")], "src string, dst string")
    targets = spark.createDataFrame([(f"t{i}.py",) for i in range(41)] + [("t3.py",)], "target string")
    found = impact.affected(edges, targets, functions, called, ",")
    assert bytes_shuffled(found) < 100_000
    rows = {tuple(r) for r in found.collect()}
    assert found.count() == 42 and rows == {(f"t{i}.py", "t1.py" if i == 0 else "", "", f"f{i},g{i}" if i < 40 else "", ",".join(sorted(callers)) if i < 40 else "") for i in range(41)}
    lists = impact.affected(edges, targets, functions, called)
    assert {(r["target"], r["function_callers"][-1] if r["function_callers"] else "", len(r["function_callers"])) for r in lists.collect()} == {(f"t{i}.py", max(callers) if i < 40 else "", 300 if i < 40 else 0) for i in range(41)}
    monkeypatch.setattr(impact, "BROADCAST", 0)
    assert {tuple(r) for r in impact.affected(edges, targets, functions, called, ",").collect()} == rows


def test_function_impact_lists_a_name_once(calls):
    functions, called, _, _ = calls
    found = impact.function_impact(functions, called)
    assert rows_made(found) <= 10 * N
    assert {(r["name"], r["n"]) for r in found.collect()} == {("f", N), ("g", 0)}


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_function_impact_as_texts(spark, monkeypatch, most):
    monkeypatch.setattr(impact, "BROADCAST", most)
    monkeypatch.setattr(impact, "SLICE", 2)
    functions = spark.createDataFrame([("f", f"{i}.py", 1) for i in range(9)] + [("g", "0.py", 1), ("h", "0.py", 1), (None, "0.py", 1), ("f", None, 1)], "name string, file string, line int")
    called = spark.createDataFrame([(f"{i}.py", "f") for i in range(100)] + [("0.py", "g"), ("0.py", "f"), (None, "h")], "file string, callee string")
    found = {(r["file"], r["name"]): (r["callers"], r["n"]) for r in impact.function_impact(functions, called, ";").collect()}
    others = lambda i: sorted(f"{k}.py" for k in range(100) if k != i)
    none = ("", 0)
    assert found == {(f"{i}.py", "f"): (";".join(others(i)), 99) for i in range(9)} | {("0.py", "g"): none, ("0.py", "h"): none, ("0.py", None): none, (None, "f"): none}


def test_resolved_calls_come_from_sorted_rows(calls):
    functions, called, _, _ = calls
    found = resolve.resolve_calls(called, functions)
    assert rows_made(found, "SortMergeJoin") == found.count() == N * (N + 1)


def test_function_calls_are_not_shuffled_as_pairs(spark, calls):
    functions, _, _, _ = calls
    between = spark.createDataFrame([(f"{i}.py", "g", "f") for i in range(N)], "file string, caller string, callee string")
    found = resolve.resolve_function_calls(between, functions)
    assert rows_made(found, "Exchange") <= 10 * N and found.count() == N * N


def test_ids_that_names_share_are_given_once(spark):
    functions = spark.createDataFrame([("c", "a::b"), ("b::c", "a"), ("f", "x")], "name string, file string")
    between = spark.createDataFrame([("x", "f", "c"), ("x", "f", "b::c")], "file string, caller string, callee string")
    assert [tuple(r) for r in resolve.resolve_function_calls(between, functions).collect()] == [("x::f", "a::b::c")]


def test_function_graph_without_pairs(spark, calls):
    functions, called, _, _ = calls
    between = spark.createDataFrame([("0.py", "g", "f"), ("0.py", "g", "none")], "file string, caller string, callee string")
    nodes, edges = projections.function_graph(functions, called, between)
    assert rows_made(nodes) <= 10 * N and rows_made(edges, "Exchange") <= 10 * N
    assert sorted((r["id"], r["type"]) for r in nodes.collect()) == sorted([(f"{i}.py::f", "function") for i in range(N)] + [("0.py::g", "function"), ("x.py", "file")] + [(f"{i}.py", "file") for i in range(N)])
    assert edges.count() == edges.distinct().count() == N * (N + 1) - N + N


def test_function_graph_leaves_out_what_only_its_own_file_calls(spark):
    functions = spark.createDataFrame([("f", "a.py", 1), ("g", "b.py", 2)], "name string, file string, line int")
    called = spark.createDataFrame([("a.py", "f"), ("a.py", "g")], "file string, callee string")
    none = spark.createDataFrame([], "file string, caller string, callee string")
    nodes, edges = projections.function_graph(functions, called, none)
    assert {r["id"] for r in nodes.collect()} == {"a.py", "b.py::g"} and [tuple(r)[:2] for r in edges.collect()] == [("a.py", "b.py::g")]


def test_words_of_vectors_are_summed_where_they_are(spark):
    texts = spark.createDataFrame([(i, " ".join(f"w{i * k % 401}" for k in range(400))) for i in range(N)], "id long, text string")
    words = retrieval.counted(texts)
    found = retrieval.hashed(texts, retrieval.dictionary(texts, words=words), words=words)
    assert words.count() > 300 * (N - 2) and rows_made(found, "Exchange") <= 64 * N
    # Words that are not broadcast, and those that the dictionary lacks, weigh the same.
    terms = retrieval.dictionary(texts).filter("word <> 'w7'")
    one, other = ({(r["id"], r["place"]): round(r["value"], 9) for r in retrieval.hashed(texts, terms, frequent=k).collect()} for k in (1000, 5))
    assert one == other and {i for i, _ in one} == set(range(N))


def test_rows_with_the_same_id_are_one_text(spark):
    texts = spark.createDataFrame([(1, "A b"), (1, "b, c__1"), (2, None), (None, "b"), (3, " ,")], "id long, text string")
    assert {tuple(r) for r in retrieval.counted(texts).collect()} == {(1, "a", 1), (1, "b", 2), (1, "c__1", 1), (None, "b", 1)}
    assert {r["id"] for r in retrieval.hashed(texts, retrieval.dictionary(texts)).collect()} == {1}


def test_calls_get_tasks_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "ROWS", 500, raising=False)
    x = fixtures.Fixtures(spark, "/root/testdata/sf0.001")
    calls = x.file_calls()
    assert calls.rdd.getNumPartitions() >= x.raw("lineitem").count() // 500 > 4
    assert calls.count() == calls.distinct().count() > 0


def test_loops_over_edges_get_tasks_by_few_bytes(spark, monkeypatch):
    key, seen, real = "spark.sql.adaptive.advisoryPartitionSizeInBytes", [], shared.written
    monkeypatch.setattr(shared, "written", lambda df, name="table": (seen.append((name, df.sparkSession.conf.get(key, None))), real(df, name))[1])
    before = spark.conf.get(key, None)
    edges = spark.createDataFrame([(8 * k + i, 8 * k + (i + 1) % 4) for k in range(9) for i in range(4)], "src long, dst long")
    found = graph.cycles(edges, None, searched=1)
    assert {name for name, _ in seen} >= {"edges", "within", "open", "closed"} and {size for _, size in seen} == {"2m"} and spark.conf.get(key, None) == before
    assert sorted(r["path"] for r in found.collect()) == [[8 * k + i for i in range(4)] for k in range(9)]


def test_likelihoods_take_little_more_memory_than_texts():
    import tracemalloc

    import numpy as np

    from lodestone.llm import language

    texts, model = ["some words of a text " * 700] * 512, [(-10.0, np.arange(5000, dtype=np.uint16), np.ones(5000, np.float32))] * 6
    tracemalloc.start()
    language.likelihoods(texts, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, texts)) < language.PIECE * 64 and peak < 45e6


def test_pairs_of_one_name_are_made_in_several_tasks(spark, calls, monkeypatch):
    monkeypatch.setattr(resolve, "ROWS", 10, raising=False)
    functions, _, _, _ = calls
    between = spark.createDataFrame([(f"{i}.py", "g", "f") for i in range(N)], "file string, caller string, callee string")
    found = resolve.resolve_function_calls(between, functions)
    tasks = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == found.distinct().count() == N * N and max(tasks) < 0.7 * N * N
