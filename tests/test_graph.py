import itertools
import random

import pytest

from lodestone.operators import graph, impact
from lodestone.functions import rules
from pyspark.sql import functions as F


def edge_table(spark, pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


#: A loop, cycles of two and three, a node by itself in a chain, and nodes at distances one to four from t.
FIXED = [("l", "l"), ("a", "b"), ("b", "a"), ("c", "d"), ("d", "e"), ("e", "c"), ("n1", "t"), ("n2", "n1"), ("n3", "n2"), ("n4", "n3"), ("a", "t")]


def reachable(pairs, start, depth):
    """{node: steps} backwards from start."""
    found, level = {}, {start}
    for k in range(1, depth + 1):
        level = {a for a, b in pairs if b in level}
        for x in level:
            found.setdefault(x, k)
    return found


def test_dependents(spark):
    got = {(r["target"], r["node"]): r["dist"] for r in graph.dependents(edge_table(spark, FIXED), spark.createDataFrame([("t",), ("c",)], "target string"), 3).collect()}
    want = {(t, n): d for t in ("t", "c") for n, d in reachable(FIXED, t, 3).items()}
    assert got == want and got["c", "c"] == 3 and ("t", "n4") not in got


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    names = [f"v{i:02d}" for i in range(12)]
    pairs = sorted({(rng.choice(names), rng.choice(names)) for _ in range(24)})
    plain = [(a, b) for a, b in pairs if a != b]
    e = edge_table(spark, pairs)
    # Cycles by trying all simple walks.
    cycles = set()

    def walk(path):
        for a, b in plain:
            if a == path[-1]:
                if b == path[0]:
                    cycles.add(tuple(path))
                elif b > path[0] and b not in path and len(path) < 6:
                    walk([*path, b])

    for x in names:
        walk([x])
    assert {tuple(r["path"]) for r in graph.cycles(e, 6).collect()} == cycles
    every = set()

    def further(path):
        for a, b in plain:
            if a == path[-1]:
                if b == path[0]:
                    every.add(tuple(path))
                elif b > path[0] and b not in path:
                    further([*path, b])

    for x in names:
        further([x])
    assert {tuple(r["path"]) for r in graph.cycles(e, None).collect()} == every
    assert tuple(graph.count_cycles(e, None).first()) == (len(every), False)
    reach = {x: set(reachable(plain, x, 12)) for x in names}
    member = {x: max(y for y in names if y == x or (y in reach[x] and x in reach[y])) for x in names if x in reach[x]}
    assert {r["node"]: r["component"] for r in graph.components(e).collect()} == member
    assert {r["node"]: r["component"] for r in graph.spread_components(e).collect()} == member
    trails = {}

    def extend(a, c, used):
        if len(used) >= 2:
            trails[a, c] = trails.get((a, c), 0) + 1
        if len(used) < 4:
            for x in plain:
                if x[0] == c and x not in used:
                    extend(a, x[1], [*used, x])

    for x in plain:
        extend(x[0], x[1], [x])
    assert {(r["src"], r["dst"]): r["paths"] for r in graph.trails(graph.clean(e), 2, 4).collect()} == trails
    degrees = {r["node"]: (r["fan_in"], r["fan_out"]) for r in graph.degrees(graph.clean(e)).collect()}
    assert sum(i for i, _ in degrees.values()) == sum(o for _, o in degrees.values()) == len(plain)
    risk = {r["file"]: r for r in impact.structural_risk(graph.clean(e)).collect()}
    assert {x for x, r in risk.items() if r["in_cycle"]} == set(member)


def test_empty_graph(spark):
    e = edge_table(spark, [])
    assert graph.components(e).count() == graph.spread_components(e).count() == graph.cycles(e).count() == graph.degrees(e).count() == 0
    assert impact.coupling_metrics(e, spark.createDataFrame([], "node string")).first()["avg_coupling"] == 0


def test_a_limit_of_cycles_is_told(spark):
    e = edge_table(spark, [(f"r{i:02d}", f"r{(i + 1) % 12:02d}") for i in range(12)] + [("a", "b"), ("b", "a")])
    assert tuple(graph.count_cycles(e, 8).first()) == (1, True) and tuple(graph.count_cycles(e, 12).first()) == (2, False) and tuple(graph.count_cycles(e, None).first()) == (2, False)


def test_trails_of_a_two_cycle(spark):
    got = {(r["src"], r["dst"]): r["paths"] for r in graph.trails(edge_table(spark, [("a", "b"), ("b", "a"), ("a", "c")]), 2, 5).collect()}
    assert got == {("a", "a"): 1, ("b", "b"): 1, ("b", "c"): 1, ("a", "c"): 1}


def test_rules_at_their_limits(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    assert [value(rules.structural_level(F.lit(s))) for s in (29, 30, 59, 60, 79, 80)] == ["low", "medium", "medium", "high", "high", "critical"]
    assert [value(rules.structural_score(F.lit(i), F.lit(o), F.lit(c))) for i, o, c in ((5, 6, False), (6, 5, False), (1, 1, True), (9, 9, True))] == [80, 83, 43, 100]
    assert [value(rules.delete_level(F.lit(s))) for s in (29, 30, 59, 60, 99, 100)] == ["low", "medium", "medium", "high", "high", "critical"]
    assert [value(rules.move_level(F.lit(n))) for n in (5, 6, 10, 11)] == ["low", "medium", "medium", "high"]
    assert [value(rules.modify_level(F.lit(n))) for n in (8, 9, 15, 16)] == ["low", "medium", "medium", "high"]
    risk = lambda kind, *n: tuple(value(rules.change_risk(F.lit(kind), *map(F.lit, n))))
    assert risk("delete", 2, 0, 2, 1) == ("critical", 100) and risk("move", 11, 0, 0, 0) == ("high", 88) and risk("rename", 10, 11, 0, 0) == ("high", 100)
    assert [value(rules.coupling_level(F.lit(x))) for x in (1.4, 1.5, 3.0, 5.0)] == ["Low", "Moderate", "High", "Critical"]
    assert value(rules.share(F.lit(0), F.lit(0))) == 50.0 and value(rules.health(F.lit(9.0))) == 100.0 and value(rules.signed(F.lit(3))) == "+3"


def test_high_coupling_threshold(spark):
    e = edge_table(spark, [("h", f"x{i}") for i in range(6)] + [("k", f"x{i}") for i in range(5)])
    assert [(r["file"], r["total"], r["severity"]) for r in impact.high_coupling(e).collect()] == [("h", 6, "high")]


def test_blast_radius_counts(spark):
    e = edge_table(spark, [(f"d{i}", "t") for i in range(3)] + [("i1", "d0"), ("i2", "i1"), ("far", "i2"), ("t", "d0")])
    fns = spark.createDataFrame([("f", "t", 1), ("g", "t", 9)], "name string, file string, line int")
    calls = spark.createDataFrame([("d0", "f"), ("other", "f"), ("other", "f"), ("t", "g"), ("x", "unknown")], "file string, callee string")
    targets = spark.createDataFrame([("t",), ("nobody",)], "target string")
    got = {r["target"]: tuple(r)[1:] for r in impact.blast_radius(e, targets, fns, calls, "delete").collect()}
    assert got["t"] == (3, 2, 5, 2, 2, "critical", 100) and got["nobody"] == (0, 0, 0, 0, 0, "low", 0)


@pytest.mark.parametrize(
    "files, links, want",
    [
        (["/a/controllers/x.py", "/a/services/y.py", "/a/dao/z.py"], [(0, 1)], ("layered", True, 0.85)),
        (["/a/controllers/x.py", "/a/services/y.py", "/a/dao/z.py"], [(0, 2)], ("layered", True, 0.6)),
        (["/a/controllers/x.py", "/a/services/y.py"], [(0, 1)], ("layered", False, 0.5)),
        (["/a/b/user_controller.py", "/a/b/item_model.py", "/a/b/page.py", "/a/b/view2.py"], [(0, 1), (2, 3)], ("mvc", True, 0.9)),
        (["/a/b/user_controller.py", "/a/b/item_model.py"], [(0, 1)], ("mvc", True, 0.75)),
        (["/a/b/user_controller.py", "/a/b/item_model.py"], [(1, 0)], ("mvc", True, 0.5)),
        (["/a/b/mail_port.py", "/a/b/db_adapter.py", "/a/domain/x.py"], [(2, 0)], ("hexagonal", True, 0.8)),
        (["/a/b/mail_port.py", "/a/b/db_adapter.py", "/a/domain/x.py"], [(2, 1)], ("hexagonal", True, 0.5)),
        (["/a/b/mail_port.py", "/a/b/db_adapter.py"], [(0, 1)], ("hexagonal", False, 0.0)),
        (["/a/b/event.py", "/a/b/emitter.py", "/a/b/listener1.py", "/a/b/listener2.py"], [(0, 1), (2, 3)], ("event_driven", True, 0.75)),
        (["/a/b/message.py", "/a/b/consumer.py"], [(0, 1)], ("event_driven", True, 0.5)),
    ],
)
def test_patterns(spark, files, links, want):
    e = edge_table(spark, [(files[i], files[j]) for i, j in links])
    nodes = spark.createDataFrame([(f,) for f in files], "node string")
    got = {r["pattern"]: (r["pattern"], r["detected"], r["confidence"]) for r in impact.detect_patterns(nodes, e).collect()}
    assert got[want[0]] == want


def test_pairs_of_neighbours(spark):
    got = {r["node"]: r["neighbours"] for r in graph.neighbours(edge_table(spark, FIXED)).collect()}
    assert got["t"] == ["a", "n1"] and all(x in got[y] for x, own in got.items() for y in own) and "l" not in got
    assert len(list(itertools.chain(*got.values()))) % 2 == 0


def walked(plain, low, high):
    """Trails by loops."""
    found = {}

    def extend(a, c, used):
        if len(used) >= low:
            found[a, c] = found.get((a, c), 0) + 1
        if len(used) < high:
            for x in plain:
                if x[0] == c and x not in used:
                    extend(a, x[1], [*used, x])

    for x in plain:
        extend(x[0], x[1], [x])
    return found


@pytest.mark.parametrize("seed", range(4))
def test_trails_by_sums(spark, seed):
    rng = random.Random(seed)
    pairs = [(a, b) for a in "abcdef" for b in "abcdef" if a != b]
    plain = rng.sample(pairs, 9 + 4 * seed)
    loops = [("a", "a"), ("c", "c")] if seed == 3 else []
    for low, high in ((1, 5), (5, 5), (2, 3)):
        got = graph.trails(edge_table(spark, plain + loops), low, high)
        assert {(r["src"], r["dst"]): r["paths"] for r in got.collect()} == walked(plain + loops, low, high)


def test_trails_through_a_hub(spark):
    """A hub has a million walks of two edges; no walk carries its edges."""
    e = edge_table(spark, [(f"i{k}", "hub") for k in range(1000)] + [("hub", f"o{k}") for k in range(1000)] + [("o7", "i7")])
    got = graph.trails(e, 2, 5)
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "array_append" not in plan and "array_contains" not in plan
    # Of two edges, of three, four and five; the way back by o7 and i7 is gone once.
    walks = 1_000_000 + 2, 2 * 1000 + 1, 2 * 999, 999 * 999
    assert tuple(got.agg(F.count("*"), F.sum("paths")).first()) == (1_000_000 + 2 * 1000 + 2 * 999 + 3, sum(walks))


def test_components_in_few_rounds(spark, monkeypatch):
    from lodestone.sources.fixtures import Fixtures

    rounds, plain = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name="table": rounds.append(name) or plain(df, name))
    e = Fixtures(spark, "/root/testdata/sf0.01").edges()
    got = {(r["node"], r["component"]) for r in graph.spread_components(e).collect()}
    # The graph's longest ways have some 30 edges; a round goes two.
    assert len(rounds) < 35
    assert got == {(r["node"], r["component"]) for r in graph.components(e).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_cycles_by_search_and_by_joins(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(9)]
    e = edge_table(spark, {(a, b) for a in names for b in names if a != b and rng.random() < 0.25 + 0.1 * seed} | {("z", "y"), ("y", "z")})
    for longest in (3, None):
        by_search = sorted(tuple(r["path"]) for r in graph.cycles(e, longest).collect())
        assert by_search == sorted(tuple(r["path"]) for r in graph.cycles(e, longest, searched=0).collect()) and len(set(by_search)) == len(by_search) > 0


def test_blocked_nodes_are_freed():
    """A node that led nowhere at first is on cycles later."""
    pairs = [(0, 1), (1, 2), (2, 3), (3, 1), (1, 4), (4, 0), (3, 0), (2, 4), (4, 2)]
    after, before = {}, {}
    for a, b in pairs:
        after.setdefault(a, []).append(b)
        before.setdefault(b, []).append(a)
    got = sorted(p for s, b in pairs if b > s for p in graph._circuits(s, b, after, before, None))

    def plainly(path):
        for a, b in pairs:
            if a == path[-1]:
                if b == path[0]:
                    yield list(path)
                elif b > path[0] and b not in path:
                    yield from plainly([*path, b])

    assert got == sorted(p for s in range(5) for p in plainly([s]))


def test_cycles_of_any_length_come_as_a_stream(spark):
    """The graph of files has more cycles of any length than could be held."""
    from lodestone.sources.fixtures import Fixtures

    few = graph.cycles(Fixtures(spark, "/root/testdata/sf0.01").edges(), None).limit(3000).collect()
    assert len({tuple(r["path"]) for r in few}) == 3000 and max(len(r["path"]) for r in few) > 8
