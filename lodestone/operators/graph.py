"""Traversals and graph algorithms over edge tables (src, dst).

Loops run on the driver; their tables stay on the executors. Unbounded loops cut
their lineage with tables written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import shared

#: Edges that one task may search by itself; edges within components that are broadcast to be searched from each first edge; nodes of the longest cycles that are given unless more are asked for.
LOCAL, SEARCHED, LONGEST = 1_000_000, 100_000, 8


def written(df: DataFrame, name: str) -> DataFrame:
    """:func:`shared.written`, by tasks whose rows are bounded: tables here are narrow and compress well."""
    with shared.small_tasks(df.sparkSession):
        return shared.written(df, name)


def clean(edges: DataFrame) -> DataFrame:
    """Each edge once, without loops."""
    return edges.select("src", "dst").filter("src <> dst").distinct()


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def degrees(edges: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """(node, fan_in, fan_out) of the edges' nodes, or of ``every`` (node). One aggregation of both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    found = ends.groupBy("e.node").agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))
    return found if every is None else every.select("node").join(found, "node", "left").na.fill(0, ["fan_in", "fan_out"])


def dependents(edges: DataFrame, targets: DataFrame, depth: int) -> DataFrame:
    """(target, node, dist): who reaches a target (target) in 1..depth steps, and in how few. A target reaches itself on a cycle."""
    level = targets.select("target", F.col("target").alias("node"))
    found = None
    for k in range(1, depth + 1):
        level = level.join(edges.select("src", "dst"), F.col("node") == F.col("dst")).select("target", F.col("src").alias("node")).distinct()
        one = level.withColumn("dist", F.lit(k))
        found = one if found is None else found.unionByName(one)
    return found.groupBy("target", "node").agg(F.min("dist").alias("dist"))


def direct(reached: DataFrame) -> DataFrame:
    return reached.filter("dist = 1 AND node <> target").select("target", "node")


def indirect(reached: DataFrame) -> DataFrame:
    return reached.filter("dist > 1 AND node <> target").select("target", "node")


def _times(x: DataFrame, y: DataFrame) -> DataFrame:
    """(a, c, n): how many walks through ``x`` (a, c, n) and then ``y`` there are between each pair; summed up before the shuffle."""
    right = y.select(F.col("a").alias("by"), F.col("c").alias("to"), F.col("n").alias("m"))
    return x.join(right, F.col("c") == F.col("by")).groupBy("a", F.col("to").alias("c")).agg(F.sum(F.col("n") * F.col("m")).alias("n"))


def _sum(*terms: tuple[int, DataFrame]) -> DataFrame:
    """(a, c, n): the sum of tables, each with its factor."""
    total = None
    for k, t in terms:
        one = t.select("a", "c", (F.col("n") * k).alias("n"))
        total = one if total is None else total.unionByName(one)
    return total.groupBy("a", "c").agg(F.sum("n").alias("n")).filter("n <> 0")


def trails(edges: DataFrame, low: int, high: int) -> DataFrame:
    """(src, dst, paths): pairs joined by walks of low..high edges that repeat none, and how many there are.

    Without loops and up to five edges, walks are counted, not made: of the walks whose later edges all differ, those that
    have the first edge again are taken away. So work grows with the pairs that walks join, not with the walks. Otherwise
    each walk carries its edges.
    """
    own = edges.select("src", "dst")
    if high > 5 or not own.filter("src = dst").isEmpty():
        return _walked(own, low, high)
    a = written(own.groupBy(F.col("src").alias("a"), F.col("dst").alias("c")).agg(F.count("*").alias("n")), "steps")
    if not a.filter("n > 1").isEmpty():
        return _walked(own, low, high)
    # Pairs with ways forward of one edge and back of one, two or three; nodes by how many of their edges have one back.
    back = lambda m: a.join(m.select(F.col("c").alias("a"), F.col("a").alias("c"), F.col("n").alias("m")), ["a", "c"]).select("a", "c", (F.col("n") * F.col("m")).alias("n"))
    twice = written(_times(a, a), "steps") if high > 1 else None
    found = {1: a, 2: twice}
    if high > 2:
        pair = written(back(a), "steps")
        found[3] = written(_sum((1, _times(a, twice)), (-1, pair)), "steps")
    if high > 3:
        ring = written(back(twice), "steps")
        turn = pair.groupBy("a").agg(F.sum("n").alias("n")).select("a", F.col("a").alias("c"), "n")
        found[4] = written(_sum((1, _times(a, found[3])), (-1, _times(pair, a)), (-1, ring), (1, turn)), "steps")
    if high > 4:
        # Walks of three edges back to a pair: all of them, so those that :data:`found` left out are in.
        square = back(_sum((1, found[3]), (1, pair)))
        chord = ring.select(F.col("c").alias("a"), F.col("a").alias("c"), "n")
        found[5] = _sum((1, _times(a, found[4])), (-1, _times(pair, twice)), (-1, _times(ring, a)), (-1, square), (1, _times(turn, a)), (1, chord), (1, pair))
    return _sum(*[(1, found[k]) for k in range(low, high + 1)]).select(F.col("a").alias("src"), F.col("c").alias("dst"), F.col("n").alias("paths"))


def _walked(edges: DataFrame, low: int, high: int) -> DataFrame:
    """:func:`trails` by walks that carry their edges."""
    e = edges.select("src", "dst", F.struct("src", "dst").alias("edge"))
    step = e.select(F.col("src").alias("a"), F.col("dst").alias("c"), F.array("edge").alias("walk"))
    found = None
    for k in range(1, high + 1):
        if k > 1:
            step = step.join(e, (F.col("c") == F.col("src")) & ~F.array_contains("walk", F.col("edge"))).select("a", F.col("dst").alias("c"), F.array_append("walk", F.col("edge")).alias("walk"))
        if k >= low:
            found = step.select("a", "c") if found is None else found.unionByName(step.select("a", "c"))
    return found.groupBy(F.col("a").alias("src"), F.col("c").alias("dst")).agg(F.count("*").alias("paths"))


def core(edges: DataFrame, each: int = 3, enough: int = 0) -> DataFrame:
    """The edges that are left when nodes without edges in or out are taken away again and again, until no more than ``enough`` are; all cycles are among them."""
    now, n = written(clean(edges), "edges"), -1
    while enough < (m := now.count()) != n:
        n = m
        for _ in range(each):
            now = now.join(now.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            now = now.join(now.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        now = written(now, "edges")
    return now


def _spread(edges: DataFrame, each: int = 2) -> DataFrame:
    """(node, f, b): the greatest node that reaches each node, and the greatest that it reaches, itself included, by the same rounds of ``each`` steps.

    What reaches the greatest node known to reach a node reaches it as well, so each round ends with a jump to that node's own
    values, and long ways take rounds by their logarithm rather than by their length.
    """
    values, total = nodes(edges).select("node", F.col("node").alias("f"), F.col("node").alias("b")), None
    while True:
        for _ in range(each):
            ends = edges.join(values.select(F.col("node").alias("src"), "f"), "src").join(values.select(F.col("node").alias("dst"), "b"), "dst")
            none = F.lit(None).cast(dict(values.dtypes)["f"])
            moved = ends.select(F.explode(F.array(F.struct(F.col("dst").alias("node"), "f", none.alias("b")), F.struct(F.col("src").alias("node"), none.alias("f"), "b"))).alias("m")).select("m.*")
            values = values.unionByName(moved).groupBy("node").agg(F.max("f").alias("f"), F.max("b").alias("b"))
        values = written(values, "colors")
        values = values.join(values.select(F.col("node").alias("f"), F.col("f").alias("ff")), "f").join(values.select(F.col("node").alias("b"), F.col("b").alias("bb")), "b")
        values = written(values.select("node", F.col("ff").alias("f"), F.col("bb").alias("b")), "colors")
        seen = values.agg(F.sum(F.xxhash64("node", "f", "b").cast("decimal(38,0)"))).first()[0]
        if seen == total:
            return values
        total = seen


def _tarjan(pairs) -> list[tuple]:
    """(node, component) of nodes on cycles, by one depth-first search without recursion."""
    following: dict = {}
    for a, b in pairs:
        following.setdefault(a, []).append(b)
        following.setdefault(b, [])
    order, low, held, on, out = {}, {}, [], set(), []
    for root in following:
        if root in order:
            continue
        walk = [(root, iter(following[root]))]
        order[root] = low[root] = len(order)
        held.append(root)
        on.add(root)
        while walk:
            at, rest = walk[-1]
            for b in rest:
                if b not in order:
                    order[b] = low[b] = len(order)
                    held.append(b)
                    on.add(b)
                    walk.append((b, iter(following[b])))
                    break
                if b in on:
                    low[at] = min(low[at], order[b])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[at])
                if low[at] == order[at]:
                    member = []
                    while not member or member[-1] != at:
                        member.append(held.pop())
                        on.discard(member[-1])
                    if len(member) > 1:
                        greatest = max(member)
                        out += [(x, greatest) for x in member]
    return out


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(node, component) by one depth-first search over all edges, in one task."""
    kind = dict(edges.dtypes)["src"]

    def run(batches):
        import pyarrow as pa

        same: dict = {}
        pairs = ((same.setdefault(a, a), same.setdefault(b, b)) for batch in batches for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for k in range(0, len(found := _tarjan(pairs)), 10_000):
            yield pa.RecordBatch.from_pylist([{"node": x, "component": c} for x, c in found[k : k + 10_000]])

    return edges.coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def components(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """(node, component): nodes that lie on a cycle, and the greatest node of their strongly connected component.

    Up to ``local`` edges go through one depth-first search in one task, which saves the rounds; the count is checked first.
    Beyond it :func:`spread_components` does the work.
    """
    own = written(clean(edges), "edges")
    return spread_components(own, local) if own.count() > local else _in_one_task(own)


def spread_components(edges: DataFrame, local: int = LOCAL // 10) -> DataFrame:
    """:func:`components` of a graph of any size.

    Nodes without edges in or out are taken away first. Then every node is a pivot: the greatest node that reaches it and the
    greatest that it reaches spread over the graph at once. Where they are the same node, that node's component is found. Nodes
    of one component agree in both, so of the rest only edges between nodes that do so stay, without those that lie on no
    cycle, and go through the same again. As soon as no more than ``local`` edges are left, one task finishes them.
    """
    rest, found = core(edges, enough=local), None
    while (n := rest.count()) > local:
        color = _spread(rest)
        one = color.filter("f = b").select("node", F.col("f").alias("component"))
        # A node on a way between cycles may be the greatest in both, alone.
        one = one.join(one.groupBy("component").count().filter("count > 1"), "component", "left_semi").select("node", "component")
        found = one if found is None else found.unionByName(one)
        left = color.filter("f <> b").select("node", F.struct("f", "b").alias("k"))
        same = rest.join(left.select(F.col("node").alias("src"), "k"), "src").join(left.select(F.col("node").alias("dst"), "k"), ["dst", "k"])
        rest = core(same.select("src", "dst"), enough=local)
    if n:
        last = _in_one_task(rest)
        return last if found is None else found.unionByName(last)
    empty = edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    return empty if found is None else found


def _within(edges: DataFrame) -> DataFrame:
    """(src, dst, component): the edges within a strong component, written."""
    member = components(edges)
    one = clean(edges).join(member.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(member.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst")
    return written(one.filter("a = b").select("src", "dst", F.col("a").alias("component")), "within")


def _cycle_steps(within: DataFrame, longest: int | None):
    """(closed, open) for cycles of 2, 3, .. nodes: the paths that close, and those that go on; until none does, or up to ``longest``."""
    e = within.select("src", "dst")
    step, k = e.filter("dst > src").select(F.col("src").alias("s"), F.col("dst").alias("c"), F.array("src", "dst").alias("path")), 2
    while True:
        closed = step.join(e, (F.col("c") == F.col("src")) & (F.col("s") == F.col("dst")), "left_semi").select("path")
        step = step.join(e, F.col("c") == F.col("src")).filter((F.col("dst") > F.col("s")) & ~F.array_contains("path", F.col("dst"))).select("s", F.col("dst").alias("c"), F.array_append("path", F.col("dst")).alias("path"))
        if longest is None:
            step = written(step, "open")
        yield closed, step
        if k == longest or longest is None and step.isEmpty():
            return
        k += 1


def _back(s, before: dict) -> dict:
    """How many edges each node that reaches ``s`` by greater nodes only has to it at least."""
    far, now = {s: 0}, [s]
    while now:
        some = [a for b in now for a in before.get(b, ()) if a > s and a not in far]
        for a in some:
            far.setdefault(a, far[now[0]] + 1)
        now = list(dict.fromkeys(some))
    return far


def _circuits(s, first, after: dict, before: dict, longest: int | None):
    """The cycles that begin with s, first and go by nodes greater than s only.

    Without a limit a node that led nowhere is blocked until a node that it leads to is free again (Johnson's search), so time
    is bounded by the number of cycles; with one, nodes too far from s are left out. Memory is a path and the blocked nodes.
    """
    far = _back(s, before)
    if first not in far:
        return
    path, blocked, waiting = [s, first], {s, first}, {}
    walk, hit = [iter(after[first])], [False]
    while walk:
        for b in walk[-1]:
            if b == s:
                yield list(path)
                hit[-1] = True
            elif b not in blocked and b in far and (longest is None or len(path) + far[b] <= longest):
                path.append(b)
                blocked.add(b)
                walk.append(iter(after[b]))
                hit.append(False)
                break
        else:
            walk.pop()
            v, closed = path.pop(), hit.pop()
            if closed or longest is not None:
                free = [v]
                while free:
                    x = free.pop()
                    if x in blocked:
                        blocked.discard(x)
                        free += waiting.pop(x, ())
            else:
                for b in after[v]:
                    waiting.setdefault(b, set()).add(v)
            if closed and hit:
                hit[-1] = True


def cycles(edges: DataFrame, longest: int | None = LONGEST, searched: int = SEARCHED) -> DataFrame:
    """(path): the elementary cycles of 2..``longest`` nodes, or of any length if that is None, each once and from its least node on.

    Cycles can be exponentially many, hence the limit; :func:`count_cycles` says whether longer ones may be left out. Where no
    more than ``searched`` edges lie within components, which is checked, those are broadcast and searched from each first edge
    apart, so cycles come as a stream, whatever their number. More edges are walked by joins, and without a limit the open
    and the closed paths of each length are written.
    """
    within = _within(edges)
    if within.count() > searched:
        found = None
        for closed, _ in _cycle_steps(within, longest):
            if longest is None:
                closed = written(closed, "closed")
            found = closed if found is None else found.unionByName(closed)
        return found
    spark, kind = edges.sparkSession, dict(within.dtypes)["src"]
    after: dict = {}
    before: dict = {}
    for r in within.select("src", "dst").collect():  # SEARCHED edges at most
        after.setdefault(r["src"], []).append(r["dst"])
        before.setdefault(r["dst"], []).append(r["src"])
    sent = spark.sparkContext.broadcast((after, before))

    def search(batches):
        import itertools

        import pyarrow as pa

        after, before = sent.value
        for batch in batches:
            for s, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = _circuits(s, first, after, before, longest)
                while some := list(itertools.islice(found, 1000)):
                    yield pa.RecordBatch.from_pydict({"path": some})

    return within.filter("dst > src").select("src", "dst").repartition("src", "dst").mapInArrow(search, f"path array<{kind}>")


def count_cycles(edges: DataFrame, longest: int | None = LONGEST) -> DataFrame:
    """One row (cycles, truncated): how many :func:`cycles` gives, and whether a path within a component was still open at ``longest``."""
    found = left = None
    for closed, step in _cycle_steps(_within(edges), longest):
        found, left = closed if found is None else found.unionByName(closed), step
    return found.agg(F.count("*").alias("cycles")).crossJoin(left.limit(1).agg((F.count("*") > 0).alias("truncated")))


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, neighbours): both directions, sorted."""
    both = clean(edges).select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))).alias("e"))
    return both.groupBy("e.node").agg(F.array_sort(F.collect_set("e.other")).alias("neighbours"))
