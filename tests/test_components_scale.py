"""Strong components where they are large or long: one task's work in proportion, few rounds."""

import time

from lodestone.operators import graph


def test_one_component_takes_time_in_proportion():
    n, began = 30_000, time.process_time()
    found = graph._tarjan((i, (i + 1) % n) for i in range(n))
    assert len(found) == n and {c for _, c in found} == {n - 1}
    assert time.process_time() - began < 5


def test_long_cycles_take_few_rounds(spark, monkeypatch):
    # One cycle of 60 nodes in shuffled order, a pair, and a way from one to the other that is on no cycle.
    order = [(7 * i) % 60 for i in range(60)]
    rows = [(order[i], order[(i + 1) % 60]) for i in range(60)] + [(100, 101), (101, 100), (3, 200), (200, 100)]
    rounds, written = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name="table": rounds.append(name) or written(df, name))
    found = {tuple(r) for r in graph.spread_components(spark.createDataFrame(rows, "src long, dst long"), 0).collect()}
    assert found == {(x, 59) for x in range(60)} | {(100, 101), (101, 101)}
    assert rounds.count("colors") <= 30  # a step a round took more than 33


def test_what_is_left_goes_to_one_task(spark, monkeypatch):
    rows = [(i, i + 1) for i in range(40)] + [(50, 51), (51, 50)]
    rounds, written = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name="table": rounds.append(name) or written(df, name))
    for local in (0, 10):
        assert {tuple(r) for r in graph.spread_components(spark.createDataFrame(rows, "src long, dst long"), local).collect()} == {(50, 51), (51, 51)}
    rounds.clear()
    graph.spread_components(spark.createDataFrame(rows, "src long, dst long"), 100)
    assert rounds == ["edges"]
