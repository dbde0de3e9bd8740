"""Every operator on the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns, paths, rules
from ..operators import confidence, graph, impact, projections, resolve, retrieval, snapshots, vectors, versions
from ..shared import shared_dir
from ..sources import fixtures, git, parser
from ..sources.fixtures import Fixtures
from ..sources.store import Store
from ..streaming import versions as stream
from . import reports

QUERIES, SQL = {}, {}

# Views that queries' SQL builds on, each with those that it needs.
VIEWS: dict[str, tuple[str, str]] = {}


def view(name: str, sql: str, needs: str = "") -> None:
    VIEWS[name] = (sql, needs)


def with_views(body: str, needs: str, recursive: bool = False) -> str:
    order: list[str] = []

    def add(names):
        for x in names.split():
            add(VIEWS[x][1])
            if x not in order:
                order.append(x)

    add(needs)
    parts = [f"{x} AS ({VIEWS[x][0]})" for x in order]
    more = body.strip()
    if more.upper().startswith("WITH "):
        parts.append(more[5:].partition("\nSELECT")[0])
        more = "SELECT" + more.partition("\nSELECT")[2]
    return ("WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(parts) + "\n" if parts else "") + more


def query(needs: str = "", sql: str | None = None, recursive: bool = False):
    """Register a function of fixtures under its name, with the SQL for its rows."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        if sql is not None:
            SQL[f.__name__] = with_views(sql, needs, recursive)
        return f

    return register


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _pick(values, i: str) -> str:
    return f"({_list(values)})[CAST({i} % {len(values)} AS INTEGER) + 1]"


def _any(values: str, column: str) -> str:
    return "(" + (" OR ".join(f"contains({column}, '{w}')" for w in values.split()) or "FALSE") + ")"


def _class(classes) -> str:
    whens = " ".join(f"WHEN {_any(s, 'stem')} OR {_any(d, 'dir')} THEN '{c}'" for c, s, d in classes)
    return f"CASE {whens} END"


D = "doc_id"
view("n", "SELECT count(*) AS n FROM documents")
view("f", f"SELECT doc_id AS file_id, '/repo/' || source || '/' || {_pick(fixtures.DIRECTORIES, D)} || '/' || {_pick(fixtures.STEMS, D)} || '_' || doc_id || {_pick(fixtures.EXTENSIONS, D)} AS path, {_pick(fixtures.STEMS, D)} || '_' || doc_id AS stem, {_pick(fixtures.DIRECTORIES, D)} AS dir, {_pick(fixtures.EXTENSIONS, D)} AS ext, text FROM documents")
_EDGES = """SELECT s, d, min(rule) AS rule FROM (
  SELECT s, (3 * s + 1) % n AS d, 0 AS rule FROM {nodes} WHERE s % 4 <> 0
  UNION ALL SELECT s, (7 * s + 5) % n, 1 FROM {nodes} WHERE s % 3 = 0
  UNION ALL SELECT s, s % 10, 2 FROM {nodes} WHERE s % 5 = 2) WHERE s <> d GROUP BY s, d"""
view("ids", _EDGES.format(nodes="(SELECT doc_id AS s, n FROM documents, n)"), "n")
view("e", "SELECT a.path AS src, b.path AS dst FROM ids JOIN f a ON a.file_id = s JOIN f b ON b.file_id = d", "ids f")
view("imp", f"""SELECT a.path AS file, rule AS pos, CASE (s + rule) % 4 WHEN 0 THEN b.stem WHEN 1 THEN './' || b.stem WHEN 2 THEN b.dir || '/' || b.stem ELSE b.dir || '.' || b.stem END AS module
FROM ids JOIN f a ON a.file_id = s JOIN f b ON b.file_id = d UNION ALL SELECT path, 9, {_pick(fixtures.EXTERNAL, 'file_id')} FROM f""", "ids f")
view("fn", f"SELECT name, path AS file, arg_max(p_size, p_partkey) AS line FROM (SELECT 'fn_' || (p_partkey % {fixtures.FUNCTIONS}) AS name, p_partkey % n AS file_id, p_size, p_partkey FROM part, n) JOIN f USING (file_id) GROUP BY name, path", "n f")
view("fc", f"SELECT DISTINCT path AS file, callee FROM (SELECT DISTINCT (l_suppkey * 7) % n AS file_id, 'fn_' || (l_partkey % {fixtures.FUNCTIONS}) AS callee FROM lineitem, n) JOIN f USING (file_id)", "n f")
view("calls", "SELECT fc.file, name, fn.file AS function_file FROM fc JOIN fn ON callee = name", "fc fn")
view("pe_", _EDGES.format(nodes="(SELECT p_partkey AS s, (SELECT count(*) FROM part) AS n FROM part)"))
view("ff", f"SELECT path AS file, caller, callee FROM (SELECT DISTINCT s % n AS file_id, 'fn_' || (s % {fixtures.FUNCTIONS}) AS caller, 'fn_' || (d % {fixtures.FUNCTIONS}) AS callee FROM pe_, n) JOIN f USING (file_id)", "pe_ n f")
view("fe", "SELECT DISTINCT a.file || '::' || a.name AS src, b.file || '::' || b.name AS dst FROM ff JOIN fn a ON caller = a.name AND ff.file = a.file JOIN fn b ON callee = b.name", "ff fn")
view("deg", "SELECT node AS file, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY node", "e")
view("closure", "SELECT src AS a, dst AS b FROM e UNION SELECT a, dst FROM closure JOIN e ON b = src", "e")
view("nodes", "SELECT src AS node FROM e UNION SELECT dst FROM e", "e")
view("nd", "SELECT node, lower(regexp_replace(regexp_extract(node, '[^/]*$'), '^(.+?)\\.[^.]*$', '\\1')) AS stem, lower(split_part(node, '/', -2)) AS dir FROM nodes", "nodes")
view("v", "SELECT event_type || '/' || (user_id % 20) AS file_path, sha256(props) AS hash, strftime(ts, '%Y-%m-%d') AS commit_hash, ts, 'u' || user_id AS author FROM events")
view("c", "SELECT commit_hash, min(ts) AS ts, arg_min(author, (ts, author)) AS author, 'commit ' || commit_hash AS message FROM v GROUP BY commit_hash", "v")
view("cuts", "SELECT * FROM (VALUES ('s1', '2024-01-10', '/tmp/r/src/', 1), ('s2', '2024-01-20', 'C:\\Users\\u\\r\\src\\', 2), ('s3', '2024-01-30', '/tmp/q/src/', 3)) t(snapshot_id, cut, place, k)")
view("sf", "SELECT snapshot_id, place || CASE WHEN snapshot_id = 's2' THEN replace(file_path, '/', '\\') ELSE file_path END AS path, 'src/' || file_path AS canonical, arg_max(hash, (ts, hash)) AS hash FROM v JOIN cuts ON commit_hash <= cut GROUP BY snapshot_id, place, file_path", "v cuts")
view("s", "SELECT snapshot_id, cut AS commit_hash, count(*) AS total_files, count(*) * k * 2 AS total_deps, CAST(k * 1.25 AS DOUBLE) AS avg_coupling, k % 3 AS cycle_count FROM sf JOIN cuts USING (snapshot_id) GROUP BY snapshot_id, cut, k", "sf cuts")
view("r", "SELECT substr(sha256(url), 1, 16) AS repo_id, name, url, n_nationkey FROM (SELECT 'https://example.org/' || lower(n_name) || '.git' AS url, n_name AS name, n_nationkey FROM nation)")
# Shortest distances of up to three steps to each file.
view("t", "SELECT path AS target FROM f", "f")
view("walk", "SELECT DISTINCT target, src AS node, 1 AS dist FROM t JOIN e ON dst = target UNION SELECT DISTINCT target, src, dist + 1 FROM walk JOIN e ON dst = node WHERE dist < 3", "t e")
view("reach", "SELECT target, node, min(dist) AS dist FROM walk GROUP BY target, node", "walk")
view("imp_fn", "SELECT fn.file, fn.name, calls.file AS caller FROM fn LEFT JOIN calls ON calls.function_file = fn.file AND calls.name = fn.name AND calls.file <> fn.file", "fn calls")


def targets(x: Fixtures) -> DataFrame:
    return x.paths().select(F.col("path").alias("target"))


def typed(x: Fixtures) -> DataFrame:
    return x.edges().withColumn("type", F.lit("imports"))


# Coupling and risk.

_RISK = "8 * fan_in + 5 * fan_out + CASE WHEN in_cycle THEN 30 ELSE 0 END + CASE WHEN fan_in > 5 THEN 10 ELSE 0 END + CASE WHEN fan_out > 5 THEN 10 ELSE 0 END"


@query("deg closure", f"""WITH x AS (SELECT *, EXISTS (SELECT 1 FROM closure WHERE a = file AND b = file) AS in_cycle FROM deg), y AS (SELECT *, CAST(least({_RISK}, 100) AS BIGINT) AS score FROM x)
SELECT *, CASE WHEN score >= 80 THEN 'critical' WHEN score >= 60 THEN 'high' WHEN score >= 30 THEN 'medium' ELSE 'low' END AS level FROM y""", True)
def structural_risk(x):
    return impact.structural_risk(x.edges())


@query("deg closure", f"""WITH x AS (SELECT *, EXISTS (SELECT 1 FROM closure WHERE a = file AND b = file) AS in_cycle FROM deg)
SELECT file, CAST(least({_RISK}, 100) AS BIGINT) AS score, CAST(8 * fan_in AS BIGINT) AS fan_in_pts, CAST(5 * fan_out AS BIGINT) AS fan_out_pts, CAST(CASE WHEN in_cycle THEN 30 ELSE 0 END AS BIGINT) AS cycle_pts, CAST(CASE WHEN fan_in > 5 THEN 10 ELSE 0 END AS BIGINT) AS high_fan_in_bonus, CAST(CASE WHEN fan_out > 5 THEN 10 ELSE 0 END AS BIGINT) AS high_fan_out_bonus FROM x""", True)
def risk_breakdown(x):
    return impact.risk_breakdown(impact.structural_risk(x.edges())).drop("fan_in", "fan_out", "in_cycle", "level")


@query("deg", "SELECT file AS node, fan_in, fan_out FROM deg")
def fan_in_out(x):
    return graph.degrees(x.edges())


@query("deg", "SELECT file, fan_in, fan_out, fan_in + fan_out AS total, CASE WHEN fan_in + fan_out >= 10 THEN 'critical' WHEN fan_in + fan_out >= 6 THEN 'high' ELSE 'moderate' END AS severity, round(100.0 * fan_in / (fan_in + fan_out), 6) AS fan_in_share FROM deg WHERE fan_in + fan_out > 5")
def high_coupling(x):
    return impact.high_coupling(x.edges())


@query("f e nodes", """WITH m AS (SELECT (SELECT count(*) FROM (SELECT path FROM f UNION SELECT node FROM nodes)) AS total_files, (SELECT count(*) FROM e) AS total_dependencies), a AS (SELECT *, round(total_dependencies / greatest(total_files, 1), 6) AS avg_coupling FROM m)
SELECT *, CASE WHEN avg_coupling >= 5 THEN 'Critical' WHEN avg_coupling >= 3 THEN 'High' WHEN avg_coupling >= 1.5 THEN 'Moderate' ELSE 'Low' END AS level, least(100.0, avg_coupling / 8 * 100) AS health FROM a""")
def coupling_metrics(x):
    return impact.coupling_metrics(x.edges(), x.paths().select(F.col("path").alias("node")))


@query("f", "SELECT dir, count(*) AS n FROM f GROUP BY dir ORDER BY n DESC, dir LIMIT 8")
def top_directories(x):
    return impact.directory_histogram(x.paths(), 8)


@query("deg", "SELECT file, round((fan_in + fan_out) / max(fan_in + fan_out) OVER (), 6) AS width FROM deg")
def relative_coupling(x):
    total = graph.degrees(x.edges()).select(F.col("node").alias("file"), (F.col("fan_in") + F.col("fan_out")).alias("total"))
    return total.crossJoin(F.broadcast(total.agg(F.max("total").alias("most")))).select("file", F.round(F.col("total") / F.col("most"), 6).alias("width"))


# Traversals.


@query("reach", "SELECT target, node FROM reach WHERE dist = 1 AND node <> target", True)
def direct_dependents(x):
    return graph.direct(graph.dependents(x.edges(), targets(x), 1))


@query("reach", "SELECT target, node FROM reach WHERE dist > 1 AND node <> target", True)
def indirect_dependents(x):
    return graph.indirect(graph.dependents(x.edges(), targets(x), 3))


@query("reach", "SELECT target, node, dist FROM reach", True)
def affected_files(x):
    return graph.dependents(x.edges(), targets(x), 3)


@query("t reach", "SELECT target, node, dist FROM reach WHERE node <> target UNION ALL SELECT target, target, 0 FROM t", True)
def bounded_reachability(x):
    zero = targets(x).select("target", F.col("target").alias("node"), F.lit(0).alias("dist"))
    return graph.dependents(x.edges(), targets(x), 3).filter("node <> target").unionByName(zero)


def _blast(kind: str) -> str:
    if kind == "delete":
        level, score = "CASE WHEN raw >= 100 THEN 'critical' WHEN raw >= 60 THEN 'high' WHEN raw >= 30 THEN 'medium' ELSE 'low' END", "raw"
    elif kind == "move":
        level, score = "CASE WHEN 8 * direct > 80 THEN 'high' WHEN 8 * direct > 40 THEN 'medium' ELSE 'low' END", "8 * direct"
    else:
        level, score = "CASE WHEN total > 15 THEN 'high' WHEN total > 8 THEN 'medium' ELSE 'low' END", "5 * total"
    return f"""WITH x AS (SELECT target, (SELECT count(*) FROM reach r WHERE r.target = t.target AND dist = 1 AND node <> r.target) AS direct, (SELECT count(*) FROM reach r WHERE r.target = t.target AND dist > 1 AND node <> r.target) AS indirect,
  (SELECT count(DISTINCT name) FROM imp_fn WHERE file = t.target) AS functions, (SELECT count(DISTINCT caller) FROM imp_fn WHERE file = t.target) AS callers FROM t), y AS (SELECT *, direct + indirect AS total, 30 * direct + 20 * callers + 10 * functions AS raw FROM x)
SELECT target, direct, indirect, total, functions, callers, {level} AS level, CAST(least({score}, 100) AS BIGINT) AS score FROM y"""


def _register_blast(kind: str) -> None:
    def f(x):
        return impact.blast_radius(x.edges(), targets(x), x.functions(), x.file_calls(), kind)

    f.__name__ = f"blast_radius_{kind}"
    query("t reach imp_fn", _blast(kind), True)(f)


for _kind in ("modify", "delete", "move"):
    _register_blast(_kind)


@query("t reach imp_fn", """WITH r AS (SELECT target, string_agg(node, ',' ORDER BY node) FILTER (WHERE dist = 1) AS d, string_agg(node, ',' ORDER BY node) FILTER (WHERE dist > 1) AS i FROM reach WHERE node <> target GROUP BY target),
u AS (SELECT file, string_agg(name, ',' ORDER BY name) AS f FROM (SELECT DISTINCT file, name FROM imp_fn) GROUP BY file),
k AS (SELECT file, string_agg(caller, ',' ORDER BY caller) AS c FROM (SELECT DISTINCT file, caller FROM imp_fn WHERE caller IS NOT NULL) GROUP BY file)
SELECT target, coalesce(d, '') AS direct_dependents, coalesce(i, '') AS indirect_dependents, coalesce(f, '') AS functions_affected, coalesce(c, '') AS function_callers FROM t LEFT JOIN r USING (target) LEFT JOIN u ON u.file = target LEFT JOIN k ON k.file = target""", True)
def blast_lists(x):
    return impact.affected(x.edges(), targets(x), x.functions(), x.file_calls(), ",")


@query("imp_fn", "SELECT file, name, coalesce(array_to_string(list_sort(list_distinct(list(caller) FILTER (WHERE caller IS NOT NULL))), ','), '') AS callers, count(DISTINCT caller) AS n FROM imp_fn GROUP BY file, name")
def function_impact(x):
    return impact.function_impact(x.functions(), x.file_calls(), ",")


@query("pe_", """WITH t AS (SELECT s AS a, d AS c, 1 AS k, [s || '>' || d] AS p FROM pe_ UNION ALL SELECT t.a, pe_.d, k + 1, list_append(p, pe_.s || '>' || pe_.d) FROM t JOIN pe_ ON t.c = pe_.s WHERE k < 5 AND NOT list_contains(p, pe_.s || '>' || pe_.d))
SELECT 'fn_' || a AS src, 'fn_' || c AS dst, count(*) AS paths FROM t WHERE k BETWEEN 2 AND 5 GROUP BY a, c""", True)
def call_closure(x):
    name = lambda c, to: F.concat(F.lit("fn_"), F.col(c).cast("string")).alias(to)
    return graph.trails(x.part_edges().select(name("s", "src"), name("d", "dst")), 2, 5)


@query("pe_", """WITH t AS (SELECT s AS a, d AS c, 1 AS k FROM pe_ UNION SELECT t.a, pe_.d, k + 1 FROM t JOIN pe_ ON t.c = pe_.s WHERE k < 5)
SELECT 'fn_' || a AS src, 'fn_' || c AS dst, CAST(min(k) AS INTEGER) AS dist FROM t GROUP BY a, c""", True)
def call_reachability(x):
    name = lambda c, to: F.concat(F.lit("fn_"), F.col(c).cast("string")).alias(to)
    e = x.part_edges().select(name("d", "src"), name("s", "dst"))
    return graph.dependents(e, graph.nodes(e).select(F.col("node").alias("target")), 5).select(F.col("target").alias("src"), F.col("node").alias("dst"), "dist")


_CYCLES = "WITH t AS (SELECT src AS s, dst AS c, [src] AS p FROM e UNION ALL SELECT t.s, e.dst, list_append(p, t.c) FROM t JOIN e ON t.c = e.src WHERE t.c > t.s AND len(p) < {k} AND NOT list_contains(p, t.c))"


# Edges within a component: those whose end leads back to their start.
view("ec", "SELECT e.src, e.dst FROM e JOIN closure ON closure.a = e.dst AND closure.b = e.src", "e closure")
view("tc", "SELECT src AS s, dst AS c, [src] AS p FROM ec UNION ALL SELECT tc.s, ec.dst, list_append(p, tc.c) FROM tc JOIN ec ON tc.c = ec.src WHERE tc.c > tc.s AND len(p) < 8 AND NOT list_contains(p, tc.c)", "ec")


@query("tc", "SELECT array_to_string(p, ' -> ') AS cycle, CAST(len(p) AS INTEGER) AS length FROM tc WHERE c = s", True)
def elementary_cycles(x):
    return graph.cycles(x.edges()).select(F.array_join("path", " -> ").alias("cycle"), F.size("path").alias("length"))


view("cc", "SELECT count(*) FILTER (WHERE c = s) AS cycles, count(*) FILTER (WHERE c > s AND len(p) = 8 AND NOT list_contains(p, c)) > 0 AS truncated FROM tc", "tc")


@query("cc", "SELECT * FROM cc", True)
def cycle_count(x):
    return graph.count_cycles(x.edges())


@query("", """WITH be AS (SELECT DISTINCT s, b + d AS d FROM (SELECT doc_id AS s, doc_id - doc_id % 8 AS b, unnest([(3 * doc_id + 1) % 8, (5 * doc_id + 2) % 8, (7 * doc_id + 3) % 8]) AS d FROM documents) WHERE s <> b + d),
t AS (SELECT s, d AS c, [s] AS p FROM be UNION ALL SELECT t.s, be.d, list_append(p, t.c) FROM t JOIN be ON t.c = be.s WHERE t.c > t.s AND NOT list_contains(p, t.c))
SELECT array_to_string(p, ' -> ') AS cycle, CAST(len(p) AS INTEGER) AS length FROM t WHERE c = s""", True)
def all_cycles(x):
    """The cycles of any length of a graph that has edges within blocks of eight."""
    return graph.cycles(x.block_edges(), None).select(F.array_join("path", " -> ").alias("cycle"), F.size("path").alias("length"))


@query("e", _CYCLES.format(k=5) + "\nSELECT array_to_string(min(p), ' -> ') AS cycle FROM t WHERE c = s", True)
def cycle_example(x):
    return graph.cycles(x.edges(), 5).agg(F.array_join(F.min("path"), " -> ").alias("cycle"))


@query("closure", "SELECT x.a AS node, max(x.b) AS component FROM closure x JOIN closure y ON x.b = y.a AND x.a = y.b GROUP BY x.a", True)
def strong_components(x):
    return graph.components(x.edges())


@query("closure", "SELECT x.a AS node, max(x.b) AS component FROM closure x JOIN closure y ON x.b = y.a AND x.a = y.b GROUP BY x.a", True)
def spread_components(x):
    """Strong components by the way that goes for graphs of any size."""
    return graph.spread_components(x.edges())


@query("e", "SELECT node, array_to_string(list_sort(list(DISTINCT other)), ',') AS neighbours FROM (SELECT src AS node, dst AS other FROM e UNION ALL SELECT dst, src FROM e) GROUP BY node")
def neighbourhoods(x):
    return graph.neighbours(x.edges()).withColumn("neighbours", F.array_join("neighbours", ","))


@query("reach", """WITH first AS (SELECT target, min(node) AS sink FROM reach WHERE dist = 1 AND node <> target GROUP BY target), far AS (SELECT target, node, row_number() OVER (PARTITION BY target ORDER BY node) AS k FROM reach WHERE dist > 1 AND node <> target)
SELECT target, node AS source, target AS sink FROM reach WHERE dist = 1 AND node <> target UNION ALL SELECT far.target, node, sink FROM far JOIN first USING (target) WHERE k <= 10""", True)
def blast_graph(x):
    return projections.blast_graph(graph.dependents(x.edges(), targets(x), 3))


# Resolution and projections.

_KEYS = "regexp_replace(array_to_string(list_slice(string_split(substr(path, 2), '/'), -{k}, -1), '/'), '\\.(py|js|java)', '', 'g')"


@query("f imp", f"""WITH k AS (SELECT path, rank, pos, key FROM (SELECT path, CASE ext WHEN '.py' THEN 1 WHEN '.js' THEN 2 ELSE 3 END AS rank, unnest([{{'pos': 0, 'key': stem}}, {{'pos': 1, 'key': './' || stem}}, {{'pos': 2, 'key': '../' || stem}}, {{'pos': 3, 'key': {_KEYS.format(k=3)}}}, {{'pos': 4, 'key': {_KEYS.format(k=2)}}}, {{'pos': 5, 'key': {_KEYS.format(k=1)}}}], recursive := true) FROM f)),
m AS (SELECT key, min((rank, path, pos)) AS first, arg_max(path, (rank, path, pos)) AS file FROM k GROUP BY key),
w AS (SELECT DISTINCT module FROM imp),
ex AS (SELECT module, file AS target FROM w JOIN m ON module = key),
lo AS (SELECT module, arg_min(file, first) AS target FROM (SELECT module FROM w WHERE module NOT IN (SELECT key FROM m)) JOIN m ON ends_with(module, key) OR ends_with(key, module) GROUP BY module),
al AS (SELECT * FROM ex UNION ALL SELECT * FROM lo)
SELECT DISTINCT file AS src, CASE WHEN target <> file THEN target ELSE imp.module END AS dst, CASE WHEN target <> file THEN 'imports' ELSE 'external' END AS type FROM imp LEFT JOIN al USING (module)""")
def import_resolution(x):
    return resolve.resolve_imports(x.paths(), x.imports())


@query("f imp", """WITH a AS (SELECT file AS src, replace(regexp_replace(module, '^(\\.\\.?/)+', ''), '.', '/') AS m FROM imp), b AS (SELECT path AS dst, regexp_replace(path, '\\.(py|js|java)$', '') AS bare FROM f)
SELECT DISTINCT src, dst FROM a JOIN b ON ends_with(bare, '/' || m) WHERE src <> dst""")
def import_targets(x):
    return resolve.import_targets(x.paths(), x.imports())


@query("f imp", """WITH a AS (SELECT file AS src, replace(regexp_replace(module, '^(\\.\\.?/)+', ''), '.', '/') AS m FROM imp), b AS (SELECT path AS dst, regexp_replace(path, '\\.(py|js|java)$', '') AS bare FROM f)
SELECT DISTINCT src, dst FROM a JOIN b ON ends_with(bare, m) WHERE src <> dst""")
def import_targets_by_any_suffix(x):
    return resolve.import_targets(x.paths(), x.imports(), aligned=False)


@query("f e", """WITH nm AS (SELECT path, split_part(path, '/', -1) AS name FROM f)
SELECT DISTINCT p.path AS src, q.path AS dst FROM e JOIN nm p ON split_part(e.src, '/', -1) = p.name JOIN nm q ON split_part(e.dst, '/', -1) = q.name WHERE p.path <> q.path""")
def basename_edges(x):
    return resolve.by_basename(x.paths(), x.edges())


@query("calls", "SELECT file, name, function_file FROM calls")
def call_resolution(x):
    return resolve.resolve_calls(x.file_calls(), x.functions())


@query("fe", "SELECT src, dst FROM fe")
def function_call_resolution(x):
    return resolve.resolve_function_calls(x.function_calls(), x.functions())


def _callers(x):
    own = x.functions().select(F.col("name").alias("caller"), "file")
    by_function = x.function_calls().join(own, ["caller", "file"]).select(F.col("callee").alias("name"), "file", "caller")
    by_file = x.file_calls().select(F.col("callee").alias("name"), "file")
    return resolve.merged_callers(by_function, by_file)


@query("ff fn fc", """WITH a AS (SELECT callee AS name, ff.file, caller FROM ff JOIN fn ON fn.name = caller AND fn.file = ff.file)
SELECT name, file, caller FROM a UNION ALL SELECT callee, file, NULL FROM fc WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.name = fc.callee AND a.file = fc.file)""")
def function_callers(x):
    return _callers(x)


@query("nodes", "SELECT node AS id, array_to_string(list_slice(string_split(node, '/'), -2, -1), '/') AS label FROM nodes")
def file_graph_nodes(x):
    return projections.file_graph(typed(x))[0]


@query("e", "SELECT DISTINCT src AS source, dst AS target, 'imports' AS type FROM e")
def file_graph_edges(x):
    return projections.file_graph(typed(x), x.paths())[1]


view("fg", "SELECT DISTINCT file AS source, function_file || '::' || name AS target FROM calls WHERE file <> function_file UNION SELECT src, dst FROM fe", "calls fe")


def _function_graph(x):
    return projections.function_graph(x.functions(), x.file_calls(), x.function_calls())


@query("fg fn calls", """WITH used AS (SELECT source AS id FROM fg UNION SELECT target FROM fg)
SELECT file || '::' || name AS id, name AS label, file, line, 'function' AS type FROM fn WHERE file || '::' || name IN (SELECT id FROM used) UNION ALL SELECT DISTINCT file, split_part(file, '/', -1), file, NULL, 'file' FROM calls WHERE file <> function_file""")
def function_graph_nodes(x):
    return _function_graph(x)[0]


@query("fg", "SELECT source, target, 'calls' AS type FROM fg")
def function_graph_edges(x):
    return _function_graph(x)[1]


@query("calls fn", """WITH own AS (SELECT min(file) AS file FROM fn WHERE name = 'fn_7')
SELECT DISTINCT calls.file AS source, own.file || '::fn_7' AS target FROM own JOIN calls ON own.file = function_file WHERE name = 'fn_7' AND calls.file <> own.file""")
def call_chain(x):
    return projections.call_chain("fn_7", x.functions(), resolve.resolve_calls(x.file_calls(), x.functions()))


@query("imp e", "SELECT (SELECT array_to_string(list_sort(list(DISTINCT module)), ',') FROM imp WHERE ends_with(file, '_7.js')) AS modules, (SELECT array_to_string(list_sort(list(DISTINCT dst)), ',') FROM e WHERE ends_with(src, '_7.js')) AS files")
def dependencies_of_file(x):
    found = projections.dependencies_of("_7.js", x.imports(), x.edges())
    return found.select(F.array_join("modules", ",").alias("modules"), F.array_join("files", ",").alias("files"))


@query("f imp e", """WITH few AS (SELECT path FROM f WHERE contains(path, 'service_') ORDER BY path LIMIT 5)
SELECT path, (SELECT array_to_string(list_sort(list(DISTINCT module)), ',') FROM imp WHERE file = path) AS modules, (SELECT count(*) FROM e WHERE src = path) AS out FROM few""")
def matching_files(x):
    return projections.matching_files("service_", x.paths(), x.imports(), x.edges()).withColumn("modules", F.array_join("modules", ","))


# Patterns and claims.


def _nodes(x):
    return graph.nodes(x.edges())


view("pl", f"SELECT node, {_class(patterns.LAYERED)} AS c FROM nd", "nd")
view("pm", f"SELECT node, {_class(patterns.MVC)} AS c FROM nd", "nd")
view("ph", f"SELECT node, {_class(patterns.HEXAGONAL)} AS c FROM nd", "nd")
view("pe", f"SELECT node, {_class(patterns.EVENTS)} AS c FROM nd", "nd")
_COUNTS = "count(*) FILTER (WHERE c = '{0}') AS n1, count(*) FILTER (WHERE c = '{1}') AS n2, count(*) FILTER (WHERE c = '{2}') AS n3"
_LINKS = "(SELECT count(*) FROM e JOIN {p} a ON a.node = src JOIN {p} b ON b.node = dst WHERE {w}) AS links"
view("x1", f"SELECT {_COUNTS.format('presentation', 'business', 'data')}, {_LINKS.format(p='pl', w='''(a.c = 'presentation' AND b.c = 'business') OR (a.c = 'business' AND b.c = 'data')''')} FROM pl", "pl e")
view("x2", f"SELECT {_COUNTS.format('controllers', 'models', 'views')}, {_LINKS.format(p='pm', w='''a.c = 'controllers' AND b.c = 'models' ''')} FROM pm", "pm e")
view("x3", f"SELECT {_COUNTS.format('ports', 'adapters', 'domain')}, {_LINKS.format(p='ph', w='''a.c = 'domain' AND coalesce(b.c, '') NOT IN ('domain', 'ports')''')} FROM ph", "ph e")
view("x4", f"SELECT {_COUNTS.format('events', 'publishers', 'subscribers')} FROM pe", "pe")
view("pat", """SELECT 'layered' AS pattern, least(n1, n2, n3) > 0 AS detected, CAST(CASE WHEN least(n1, n2, n3) > 0 THEN CASE WHEN links > 0 THEN 0.85 ELSE 0.6 END WHEN CAST(n1 > 0 AS INT) + CAST(n2 > 0 AS INT) + CAST(n3 > 0 AS INT) = 2 THEN 0.5 ELSE 0 END AS DOUBLE) AS confidence, n1, n2, n3, CASE WHEN least(n1, n2, n3) > 0 THEN links ELSE 0 END AS links FROM x1
UNION ALL SELECT 'mvc', n1 > 0 AND n2 > 0, CAST(CASE WHEN NOT (n1 > 0 AND n2 > 0) THEN 0 WHEN n3 >= 2 AND links > 0 THEN 0.9 WHEN links > 0 THEN 0.75 ELSE 0.5 END AS DOUBLE), n1, n2, n3, links FROM x2
UNION ALL SELECT 'hexagonal', least(n1, n2, n3) > 0, CAST(CASE WHEN least(n1, n2, n3) = 0 THEN 0 WHEN links < 0.3 * n3 THEN 0.8 ELSE 0.5 END AS DOUBLE), n1, n2, n3, links FROM x3
UNION ALL SELECT 'event_driven', n1 > 0 AND (n2 > 0 OR n3 > 0), CAST(CASE WHEN NOT (n1 > 0 AND (n2 > 0 OR n3 > 0)) THEN 0 WHEN n2 >= 1 AND n3 >= 2 THEN 0.75 ELSE 0.5 END AS DOUBLE), n1, n2, n3, 0 FROM x4""", "x1 x2 x3 x4")


@query("pat", "SELECT * FROM pat")
def architecture_patterns(x):
    return impact.detect_patterns(_nodes(x), x.edges())


for _name, _view, _classes in (("layered", "pl", patterns.LAYERED), ("mvc", "pm", patterns.MVC), ("hexagonal", "ph", patterns.HEXAGONAL), ("events", "pe", patterns.EVENTS)):

    def _classified(x, classes=_classes):
        return _nodes(x).select("node", patterns.classified(F.col("node"), classes).alias("c"))

    _classified.__name__ = f"{_name}_classes"
    query(_view, f"SELECT node, c FROM {_view}")(_classified)


def _claims(x):
    return confidence.claims(impact.detect_patterns(_nodes(x), x.edges()), impact.high_coupling(x.edges()), graph.cycles(x.edges(), 5))


view("cl", """SELECT CASE pattern WHEN 'layered' THEN 0 WHEN 'mvc' THEN 1 WHEN 'hexagonal' THEN 2 ELSE 3 END AS ord, 'pattern ' || pattern AS claim, confidence, CASE pattern
  WHEN 'layered' THEN (CAST(n1 > 0 AS INT) + CAST(n2 > 0 AS INT) + CAST(n3 > 0 AS INT)) || ' layers found'
  WHEN 'mvc' THEN CASE WHEN n1 + n2 + n3 >= 10 THEN 'strong separation' WHEN n1 + n2 + n3 >= 5 THEN 'moderate separation' ELSE 'weak separation' END
  WHEN 'hexagonal' THEN CASE WHEN n1 >= 3 AND n2 >= 3 THEN 'clear ports and adapters' ELSE 'some ports and adapters' END
  ELSE CASE WHEN n1 >= 5 OR n3 >= 5 THEN 'many events or handlers' ELSE 'some events or handlers' END END AS reasoning FROM pat WHERE detected
UNION ALL (SELECT 4, 'highest coupling: ' || file, 0.92, (fan_in + fan_out) || ' dependencies exceed the threshold' FROM deg WHERE fan_in + fan_out > 5 ORDER BY fan_in + fan_out DESC, file LIMIT 1)
UNION ALL SELECT 5, 'circular dependencies', 1.0, array_to_string(p, ' -> ') FROM (SELECT min(p) AS p FROM t5 WHERE c = s) WHERE p IS NOT NULL""", "pat deg t5")
view("t5", _CYCLES.format(k=5)[11:-1], "e")
VIEWS["t5"] = (VIEWS["t5"][0].replace("FROM t JOIN", "FROM t5 t JOIN"), "e")


@query("cl", "SELECT ord, claim, confidence, reasoning, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS bucket FROM cl", True)
def confidence_claims(x):
    return _claims(x)


@query("cl", """WITH z AS (SELECT count(*) AS total, count(*) FILTER (WHERE confidence >= 0.8) AS sure, round(avg(CAST(confidence AS DOUBLE)), 6) AS average FROM cl)
SELECT *, sure || ' of ' || total || ' claims at high confidence (average ' || printf('%.2f', average) || ')' AS text FROM z""", True)
def confidence_summary(x):
    return confidence.summary(_claims(x))


_SCENARIO = "CASE ord " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(confidence.SCENARIOS)) + " END"
_EVIDENCE = " UNION ALL ".join(f"SELECT {i} AS ord, array_to_string((SELECT list(node ORDER BY node) FROM (SELECT DISTINCT node FROM {v} WHERE c IS NOT NULL ORDER BY node LIMIT 5)), ',') AS files" for i, v in enumerate(("pl", "pm", "ph", "pe")))


@query("cl pl pm ph pe", f"""WITH ev AS ({_EVIDENCE})
SELECT ord, claim, confidence, {_SCENARIO} AS failure_scenario, coalesce(files, '') AS evidence FROM cl LEFT JOIN ev USING (ord)""", True)
def explained_claims(x):
    found = confidence.explained(_claims(x), impact.evidence(_nodes(x)))
    return found.select("ord", "claim", "confidence", "failure_scenario", F.array_join("evidence", ",").alias("evidence"))


# Versions and commits.


@query("v", "SELECT author, count(DISTINCT file_path) AS files_modified, count(*) AS total_versions FROM v GROUP BY author")
def contributors(x):
    return versions.contributors(x.versions())


@query("c", "SELECT * FROM (SELECT 'main' AS repo_id, commit_hash, lag(commit_hash) OVER (ORDER BY ts, commit_hash) AS previous FROM c) WHERE previous IS NOT NULL")
def commit_lineage(x):
    return versions.commit_lineage(x.commits())


view("h", "SELECT file_path, hash, commit_hash, author, lag(hash) OVER (PARTITION BY file_path ORDER BY ts, hash) AS previous_hash FROM v", "v")


@query("h", "SELECT * FROM h")
def file_history(x):
    return versions.file_history(x.versions()).select("file_path", "hash", "commit_hash", "author", "previous_hash")


@query("h", "SELECT * FROM h WHERE hash <> previous_hash")
def changed_versions(x):
    return versions.changed_versions(x.versions()).select("file_path", "hash", "commit_hash", "author", "previous_hash")


view("last", "SELECT file_path, arg_max(hash, (ts, hash)) AS hash, arg_max(commit_hash, (ts, hash)) AS commit_hash, arg_max(author, (ts, hash)) AS author FROM v GROUP BY file_path", "v")


@query("last", "SELECT * FROM last")
def latest_versions(x):
    return versions.latest(x.versions()).select("file_path", "hash", "commit_hash", "author")


@query("last c", "SELECT file_path, last.author, message FROM last LEFT JOIN c USING (commit_hash)")
def last_authors(x):
    return versions.last_author(x.versions(), x.commits())


def _current(x):
    """Each file as the day 2024-01-15 had it, and two that nobody knows."""
    then = versions.latest(x.versions().filter("commit_hash <= '2024-01-15'")).select("file_path", "hash")
    return then.unionByName(x.spark.createDataFrame([("new/1", "x"), ("new/2", None)], "file_path string, hash string"))


view("cur", "SELECT file_path, arg_max(hash, (ts, hash)) AS hash FROM v WHERE commit_hash <= '2024-01-15' GROUP BY file_path UNION ALL SELECT 'new/1', 'x' UNION ALL SELECT 'new/2', NULL", "v")


@query("cur last", "SELECT cur.file_path, CASE WHEN last.hash IS NULL THEN 'not_tracked' WHEN last.hash = cur.hash THEN 'intact' ELSE 'tampered' END AS status FROM cur LEFT JOIN last USING (file_path)")
def tamper_check(x):
    return versions.tampered(x.versions(), _current(x).withColumn("repo_id", F.lit("main"))).drop("repo_id")


@query("v cur", "SELECT file_path, hash FROM cur WHERE hash IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v WHERE v.file_path = cur.file_path AND v.hash = cur.hash AND v.commit_hash = '2024-01-15')")
def new_versions(x):
    scanned = _current(x).select(F.lit("main").alias("repo_id"), "file_path", "hash", F.lit("2024-01-15").alias("commit_hash"))
    return versions.new_versions(x.versions(), scanned).select("file_path", "hash")


@query("v", "SELECT file_path AS path, arg_max(hash, (ts, hash)) AS hash FROM v WHERE commit_hash = '2024-01-05' GROUP BY file_path")
def commit_files(x):
    return versions.commit_files(x.versions(), "2024-01-05")


view("two", "SELECT path, a.hash AS a, b.hash AS b FROM (SELECT file_path AS path, arg_max(hash, (ts, hash)) AS hash FROM v WHERE commit_hash = '2024-01-05' GROUP BY file_path) a FULL JOIN (SELECT file_path AS path, arg_max(hash, (ts, hash)) AS hash FROM v WHERE commit_hash = '2024-01-06' GROUP BY file_path) b USING (path)", "v")


@query("two", "SELECT path, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' WHEN a <> b THEN 'modified' ELSE 'unchanged' END AS status FROM two")
def compare_commits(x):
    return versions.compare_commits(x.versions(), "2024-01-05", "2024-01-06", unchanged=True)


@query("c v", "SELECT commit_hash, message, c.author, (SELECT count(*) FROM v WHERE v.commit_hash = c.commit_hash) AS versions FROM c")
def commits_listing(x):
    return versions.commits_listing(x.commits(), x.versions()).drop("ts")


@query("v c", "SELECT file_path, hash, commit_hash, v.author, message FROM (SELECT * FROM v ORDER BY ts DESC, file_path, hash LIMIT 100) v LEFT JOIN c USING (commit_hash)")
def versions_listing(x):
    return versions.versions_listing(x.versions(), x.commits())


@query("v", """SELECT DISTINCT 'u' || u AS repo_id, commit_hash, previous FROM (SELECT CAST(substr(author, 2) AS BIGINT) AS u, commit_hash, lag(commit_hash) OVER (PARTITION BY author ORDER BY ts, commit_hash) AS previous FROM v) WHERE previous <> commit_hash""")
def analysis_links(x):
    log = x.versions().select(F.col("author").alias("repo_id"), "commit_hash", "ts")
    return versions.analysis_links(log)


@query("", "SELECT conv_id, turn, sha256(coalesce(text, '')) AS hash, lag(sha256(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn, sha256(coalesce(text, ''))) AS previous_hash FROM conversations")
def message_history(x):
    rows = x.raw("conversations").select(F.lit("chat").alias("repo_id"), F.col("conv_id").alias("file_path"), F.col("turn").alias("ts"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    return versions.file_history(rows).select(F.col("file_path").alias("conv_id"), F.col("ts").alias("turn"), "hash", "previous_hash")


@query("v", "SELECT file_path, hash, count(*) AS n FROM v GROUP BY file_path, hash HAVING count(*) > 1")
def duplicate_keys(x):
    return versions.duplicate_keys(x.versions(), "file_path", "hash")


# Snapshots and repositories.


@query("s sf", "SELECT 'main' AS repo_id, snapshot_id, commit_hash, total_files AS file_count, CAST(row_number() OVER (ORDER BY commit_hash, snapshot_id) AS INTEGER) AS ordinal FROM s")
def snapshots_listing(x):
    return snapshots.listing(x.snapshots(), x.snapshot_files())


view("sd", "SELECT coalesce(a.canonical, b.canonical) AS path, CASE WHEN a.canonical IS NULL THEN 'added' WHEN b.canonical IS NULL THEN 'removed' WHEN a.hash <> b.hash THEN 'modified' END AS status FROM (SELECT * FROM sf WHERE snapshot_id = 's1') a FULL JOIN (SELECT * FROM sf WHERE snapshot_id = 's2') b USING (canonical)", "sf")


@query("sd", "SELECT path, status FROM sd WHERE status IS NOT NULL")
def snapshot_file_diff(x):
    return snapshots.file_diff(x.snapshot_files(), "s1", "s2")


view("sp", "SELECT 's' || k AS snapshot_id, pattern, i < k AS detected, CASE WHEN i < k THEN round(0.3 + 0.2 * k, 2) ELSE 0 END AS confidence FROM (SELECT unnest([1, 2, 3]) AS k) CROSS JOIN (SELECT unnest([0, 1, 2]) AS i, unnest(['mvc', 'layered', 'event_driven']) AS pattern)")
view("sc", "SELECT snapshot_id, path AS file FROM sf WHERE contains(substr('0123456789', 1, CAST(substr(snapshot_id, 2, 1) AS INTEGER)), substr(hash, 1, 1))", "sf")
view("spd", "SELECT pattern, CASE WHEN NOT a.detected AND b.detected THEN 'newly_detected' WHEN a.detected AND NOT b.detected THEN 'no_longer_detected' WHEN a.detected AND b.detected AND abs(round(b.confidence - a.confidence, 2)) > 0.1 THEN 'confidence_changed: ' || printf('%+.2f', round(b.confidence - a.confidence, 2)) END AS change FROM (SELECT * FROM sp WHERE snapshot_id = 's1') a JOIN (SELECT * FROM sp WHERE snapshot_id = 's2') b USING (pattern)", "sp")


@query("sd s sc spd", """WITH n AS (SELECT count(*) FILTER (WHERE status = 'added') AS added, count(*) FILTER (WHERE status = 'removed') AS removed, count(*) FILTER (WHERE status = 'modified') AS modified FROM sd),
w AS (SELECT added, removed, modified, round(b.avg_coupling - a.avg_coupling, 2) AS coupling_delta, CAST(b.cycle_count - a.cycle_count AS BIGINT) AS cycle_delta, CAST(b.total_deps - a.total_deps AS BIGINT) AS dependency_delta, b.total_files - a.total_files AS file_delta, (SELECT count(*) FROM sc WHERE snapshot_id = 's1') AS high_coupling_before, (SELECT count(*) FROM sc WHERE snapshot_id = 's2') AS high_coupling_after,
  (SELECT coalesce(string_agg(pattern || ': ' || change, '; ' ORDER BY pattern), '') FROM spd WHERE change IS NOT NULL) AS pattern_changes, (SELECT count(*) FROM spd WHERE change IS NOT NULL) AS changed_patterns FROM n, s a, s b WHERE a.snapshot_id = 's1' AND b.snapshot_id = 's2'),
ra AS (SELECT *, CAST(added > 10 AS INT) + CAST(coupling_delta > 1.0 AS INT) + CAST(cycle_delta > 0 AS INT) + CAST(high_coupling_after > high_coupling_before AS INT) AS risk_areas,
  concat_ws('; ', CASE WHEN added > 10 THEN printf('%+d', added) || ' files' END, CASE WHEN coupling_delta > 1.0 THEN 'coupling ' || printf('%+.2f', coupling_delta) END, CASE WHEN cycle_delta > 0 THEN printf('%+d', cycle_delta) || ' cycles' END, CASE WHEN high_coupling_after > high_coupling_before THEN printf('%+d', high_coupling_after - high_coupling_before) || ' highly coupled files' END) AS risks FROM w)
SELECT *, CASE WHEN risk_areas >= 3 THEN 'high' WHEN risk_areas >= 1 THEN 'medium' ELSE 'low' END AS level, coalesce(nullif(concat_ws('; ', CASE WHEN added > 0 THEN added || ' files added' END, CASE WHEN removed > 0 THEN removed || ' files removed' END, CASE WHEN modified > 0 THEN modified || ' files modified' END, CASE WHEN coupling_delta > 0.5 THEN 'coupling increased' WHEN coupling_delta < -0.5 THEN 'coupling decreased' END, CASE WHEN cycle_delta > 0 THEN cycle_delta || ' new cycles' WHEN cycle_delta < 0 THEN (-cycle_delta) || ' cycles resolved' END, CASE WHEN changed_patterns > 0 THEN changed_patterns || ' pattern changes' END), ''), 'No significant changes detected') AS summary FROM ra""")
def compare_snapshots(x):
    return snapshots.compare(x.snapshots(), x.snapshot_files(), "s1", "s2", x.snapshot_patterns(), x.snapshot_coupling())


@query("sd", "SELECT " + ", ".join(f"coalesce((SELECT string_agg(path, ',' ORDER BY path) FROM (SELECT path FROM sd WHERE status = '{k}' ORDER BY path LIMIT 20)), '') AS files_{k}" for k in ("added", "removed", "modified")))
def changed_file_lists(x):
    found = snapshots.changed_lists(x.snapshot_files(), "s1", "s2")
    return found.select(*[F.array_join(c, ",").alias(c) for c in found.columns])


view("ar", "SELECT cut AS commit_hash, CASE k WHEN 2 THEN ' ' ELSE repeat('files ' || total_files || ', ', 10 * k) END AS macro, k AS ts FROM cuts JOIN s ON s.commit_hash = cut", "cuts s")


def _architecture(x):
    """Texts on the commits of the snapshots but the second, that of the third a long one."""
    place = F.substring("snapshot_id", 2, 9).cast("int")
    return x.snapshots().select("commit_hash", F.when(place == 2, " ").otherwise(F.expr("repeat(concat('files ', total_files, ', '), 10 * int(substring(snapshot_id, 2, 9)))")).alias("macro"), place.alias("ts"))


@query("s ar", "SELECT coalesce((SELECT macro FROM ar JOIN s USING (commit_hash) WHERE snapshot_id = 's1' AND trim(macro) <> ''), 'Not cached') AS architecture_before, coalesce((SELECT macro FROM ar JOIN s USING (commit_hash) WHERE snapshot_id = 's2' AND trim(macro) <> ''), 'Not cached') AS architecture_after")
def snapshot_texts(x):
    return snapshots.described(x.snapshots(), _architecture(x), "s1", "s2")


@query("s sp ar", """WITH w AS (SELECT a.commit_hash AS before, b.commit_hash AS after, round(b.avg_coupling - a.avg_coupling, 2) AS coupling_delta, CAST(b.cycle_count - a.cycle_count AS BIGINT) AS cycle_delta, b.total_files - a.total_files AS file_delta FROM s a, s b WHERE a.snapshot_id = 's1' AND b.snapshot_id = 's3'),
ra AS (SELECT *, CAST(coupling_delta > 1.0 AS INT) + CAST(cycle_delta > 0 AS INT) + CAST(file_delta > 20 AS INT) AS risk_areas FROM w),
ch AS (SELECT pattern, CASE WHEN NOT a.detected AND b.detected THEN 'newly_detected' WHEN a.detected AND NOT b.detected THEN 'no_longer_detected' WHEN a.detected AND b.detected AND abs(round(b.confidence - a.confidence, 2)) > 0.1 THEN 'confidence_changed: ' || printf('%+.2f', round(b.confidence - a.confidence, 2)) END AS change FROM (SELECT * FROM sp WHERE snapshot_id = 's1') a JOIN (SELECT * FROM sp WHERE snapshot_id = 's3') b USING (pattern)),
c AS (SELECT coalesce(string_agg(pattern || ': ' || change, '; ' ORDER BY pattern), '') AS pattern_changes, count(change) AS changed_patterns FROM ch WHERE change IS NOT NULL),
tx AS (SELECT commit_hash, CASE WHEN length(macro) > 200 THEN substr(macro, 1, 200) || '...' ELSE macro END AS short FROM ar WHERE trim(macro) <> '')
SELECT CAST(NULL AS VARCHAR) AS error, ra.*, CASE WHEN risk_areas >= 2 THEN 'high' WHEN risk_areas = 1 THEN 'medium' ELSE 'low' END AS level, c.*, p.short AS summary_before, q.short AS summary_after,
  printf('%+d', CAST(file_delta AS BIGINT)) || ' files, coupling ' || printf('%+.2f', coupling_delta) || ', ' || printf('%+d', cycle_delta) || ' cycles, ' || changed_patterns || ' pattern changes' AS summary
FROM ra CROSS JOIN c LEFT JOIN tx p ON p.commit_hash = before LEFT JOIN tx q ON q.commit_hash = after
UNION ALL SELECT 'no snapshots of the commits 2024-01- and 1999-01-', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL""")
def architecture_reports(x):
    """Two comparisons: of commits that have snapshots, and of one that has none."""
    report = lambda second: snapshots.architecture_report(x.snapshots(), "2024-01-10", second, x.snapshot_patterns(), _architecture(x))
    return report("2024-01-3").unionByName(report("1999-01-01"))


@query("s sp sc", """SELECT snapshot_id, total_files > 0 AND (SELECT count(*) FROM sp WHERE sp.snapshot_id = s.snapshot_id) > 0 AS complete FROM s""")
def described_snapshots(x):
    return snapshots.complete(x.snapshots(), x.snapshot_files(), x.snapshot_patterns())


@query("s", """WITH w AS (SELECT a.commit_hash AS before, b.commit_hash AS after, round(b.avg_coupling - a.avg_coupling, 2) AS coupling_delta, CAST(b.cycle_count - a.cycle_count AS BIGINT) AS cycle_delta, b.total_files - a.total_files AS file_delta FROM s a, s b WHERE a.snapshot_id = 's1' AND b.snapshot_id = 's3'),
ra AS (SELECT *, CAST(coupling_delta > 1.0 AS INT) + CAST(cycle_delta > 0 AS INT) + CAST(file_delta > 20 AS INT) AS risk_areas FROM w)
SELECT *, CASE WHEN risk_areas >= 2 THEN 'high' WHEN risk_areas = 1 THEN 'medium' ELSE 'low' END AS level FROM ra""")
def compare_architecture(x):
    return snapshots.compare_architecture(x.snapshots(), "2024-01-10", "2024-01-3")


@query("ids f", """WITH b AS (SELECT p.path AS src, q.path AS dst FROM (SELECT s, d FROM ids WHERE s % 7 <> 0 UNION SELECT s, (d + 1) % (SELECT count(*) FROM documents) FROM ids WHERE s % 50 = 0) JOIN f p ON p.file_id = s JOIN f q ON q.file_id = d),
a AS (SELECT p.path AS src, q.path AS dst FROM ids JOIN f p ON p.file_id = s JOIN f q ON q.file_id = d)
SELECT *, 'added' AS status FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def edge_diff(x):
    n = F.broadcast(x.raw("documents").agg(F.count("*").alias("n")))
    e = x.id_edges()
    later = e.filter("s % 7 <> 0").select("s", "d").union(e.filter("s % 50 = 0").crossJoin(n).select("s", ((F.col("d") + 1) % F.col("n")).alias("d")))
    p = x.paths()
    named = later.join(p.select(F.col("file_id").alias("s"), F.col("path").alias("src")), "s").join(p.select(F.col("file_id").alias("d"), F.col("path").alias("dst")), "d")
    return snapshots.edge_diff(x.edges(), named)


@query("pat", """WITH o AS (SELECT pattern, NOT detected AS detected, confidence FROM pat WHERE pattern <> 'mvc' UNION ALL SELECT 'mvc', TRUE, 0.6)
SELECT pattern, change FROM (SELECT pattern, CASE WHEN NOT o.detected AND pat.detected THEN 'newly_detected' WHEN o.detected AND NOT pat.detected THEN 'no_longer_detected' WHEN o.detected AND pat.detected AND abs(round(pat.confidence - o.confidence, 2)) > 0.1 THEN 'confidence_changed: ' || printf('%+.2f', round(pat.confidence - o.confidence, 2)) END AS change FROM o JOIN pat USING (pattern)) WHERE change IS NOT NULL""")
def pattern_diff(x):
    now = impact.detect_patterns(_nodes(x), x.edges()).select("pattern", "detected", "confidence")
    old = now.select("pattern", F.when(F.col("pattern") == "mvc", True).otherwise(~F.col("detected")).alias("detected"), F.when(F.col("pattern") == "mvc", 0.6).otherwise(F.col("confidence")).alias("confidence"))
    return snapshots.pattern_diff(old, now)


@query("s sf", "SELECT snapshot_id, total_files > 0 AS complete FROM s")
def snapshot_completeness(x):
    return snapshots.complete(x.snapshots(), x.snapshot_files())


@query("s", "SELECT snapshot_id FROM s WHERE commit_hash = '2024-01-30'")
def cached_snapshot(x):
    repositories = x.spark.createDataFrame([("main", "2024-01-30")], "repo_id string, current_commit string")
    return snapshots.cached(x.snapshots(), x.snapshot_files(), repositories).select("snapshot_id")


@query("sf", "SELECT snapshot_id, string_agg(path || '=' || hash, ',' ORDER BY path) AS files FROM sf WHERE snapshot_id <> 's1' GROUP BY snapshot_id")
def preserved_files(x):
    found = snapshots.preserved(x.snapshot_files(), x.spark.createDataFrame([("s1",)], "snapshot_id string"))
    return found.select("snapshot_id", F.array_join(F.transform("files", lambda f: F.concat_ws("=", f["path"], f["hash"])), ",").alias("files"))


@query("deg closure f", f"""WITH x AS (SELECT *, EXISTS (SELECT 1 FROM closure WHERE a = file AND b = file) AS in_cycle FROM deg), y AS (SELECT file, CAST(least({_RISK}, 100) AS BIGINT) AS score FROM x), few AS (SELECT path FROM f ORDER BY path LIMIT 30)
SELECT file, score, CASE WHEN score >= 80 THEN 'critical' WHEN score >= 60 THEN 'high' WHEN score >= 30 THEN 'medium' ELSE 'low' END AS level FROM y WHERE file IN (SELECT path FROM few) AND score > 0 ORDER BY score DESC, file LIMIT 10""", True)
def riskiest_changes(x):
    return snapshots.riskiest(impact.structural_risk(x.edges()), x.paths().select(F.col("path").alias("file")))


@query("r", "SELECT repo_id, name, (SELECT count(DISTINCT s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey) AS file_count, (SELECT count(DISTINCT c_custkey) FROM customer WHERE c_nationkey = n_nationkey) AS version_count FROM r")
def repositories_listing(x):
    files = x.raw("supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.countDistinct("s_suppkey").alias("file_count"))
    shots = x.raw("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.countDistinct("c_custkey").alias("version_count"))
    found = x.repositories().join(files, "n_nationkey", "left").join(shots, "n_nationkey", "left").na.fill(0, ["file_count", "version_count"])
    return found.select("repo_id", "name", "file_count", "version_count")


# Predicates, sets and paths.


@query("f ids", "SELECT path FROM f WHERE file_id NOT IN (SELECT s FROM ids WHERE rule > 0 UNION SELECT d FROM ids WHERE rule > 0)")
def orphan_files(x):
    e = x.id_edges().filter("rule > 0").select(F.col("s").alias("src"), F.col("d").alias("dst"))
    return x.paths().join(graph.nodes(e).select(F.col("node").alias("file_id")), "file_id", "left_anti").select("path")


@query("f fn", "SELECT path FROM f WHERE path IN (SELECT file FROM fn)")
def files_with_functions(x):
    return x.paths().select("path").join(x.functions().select(F.col("file").alias("path")), "path", "left_semi")


@query("e reach", "SELECT node FROM reach WHERE node <> target UNION SELECT dst FROM e JOIN t ON src = target", True)
def structural_set(x):
    near = graph.dependents(x.edges(), targets(x), 3).filter("node <> target").select("node")
    return near.union(x.edges().join(targets(x), F.col("src") == F.col("target")).select("dst")).distinct()


@query("f", "SELECT path, split_part(path, '/', -1) AS name, stem, ext, dir AS parent, array_to_string(list_slice(string_split(path, '/'), -3, -1), '/') AS suffix, dir || '/' || split_part(path, '/', -1) AS label, CASE ext WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.java' THEN 'java' ELSE 'unknown' END AS language FROM f")
def path_parts(x):
    p = F.col("path")
    return x.paths().select("path", paths.name(p).alias("name"), paths.stem(p).alias("stem"), paths.extension(p).alias("ext"), paths.parent(p).alias("parent"), paths.last_segments(p, 3).alias("suffix"), paths.label(p).alias("label"), paths.language(paths.extension(p)).alias("language"))


@query("sf", "SELECT snapshot_id, path, canonical FROM sf")
def canonical_paths(x):
    return x.snapshot_files().select("snapshot_id", "path", paths.canonical(F.col("path")).alias("canonical"))


@query("", "SELECT page_id, url FROM pages WHERE NOT list_has_any(string_split(replace(url, '\\', '/'), '/'), ['node_modules', 'venv', '__pycache__', '.git', 'dist', 'build', 'fr'])")
def included_paths(x):
    url = F.col("url")
    return x.raw("pages").select("page_id", "url").filter(paths.included(url) & ~F.array_contains(F.split(paths.forward(url), "/"), "fr"))


@query("f", """WITH q AS (SELECT path AS asked FROM f UNION ALL SELECT dir || '/' || split_part(path, '/', -1) FROM f UNION ALL SELECT 'elsewhere/' || split_part(path, '/', -1) FROM f UNION ALL SELECT 'no/such.py'),
j AS (SELECT asked, path, CASE WHEN path = asked THEN 0 WHEN ends_with(path, asked) THEN 1 ELSE 2 END AS rank FROM q JOIN f ON split_part(path, '/', -1) = split_part(asked, '/', -1))
SELECT asked, coalesce((SELECT arg_min(path, (rank, path)) FROM j WHERE j.asked = q.asked), asked) AS path FROM q""")
def path_resolution(x):
    p = x.paths()
    name = paths.name(F.col("path"))
    asked = p.select(F.explode(F.array("path", F.concat_ws("/", paths.parent(F.col("path")), name), F.concat(F.lit("elsewhere/"), name))).alias("asked")).union(x.spark.createDataFrame([("no/such.py",)], "asked string"))
    return projections.resolved_path(asked, p)


# Vectors.


_NEAREST = """WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 100 = 0), d AS (SELECT query_id, vec_id AS id, round(list_cosine_distance(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])), 6) AS distance FROM embeddings, q)
SELECT query_id, id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 10"""


@query("", _NEAREST)
def nearest_chunks(x):
    return retrieval.search(x.chunks(), _questions(x))


@query("", _NEAREST)
def indexed_chunks(x):
    """The same by an index of cells, and its exact finish."""
    return vectors.search(vectors.build(x.chunks()), _questions(x))


@query("", r"""WITH w AS (SELECT doc_id AS id, word, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')) AS word FROM documents) WHERE word <> '' GROUP BY doc_id, word),
d AS (SELECT word, ln((1 + (SELECT count(*) FROM documents)) / CAST(1 + count(*) AS DOUBLE)) + 1 AS weight FROM w GROUP BY word),
b AS (SELECT id, CAST(CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % 64 AS INTEGER) AS place, CASE WHEN substr(md5(word), 9, 1) < '8' THEN 1.0 ELSE -1.0 END * (1 + ln(tf)) * weight AS part FROM w JOIN d USING (word)),
v AS (SELECT id, place, sum(part) AS value FROM b GROUP BY id, place), l AS (SELECT id, sqrt(sum(value * value)) AS norm FROM v GROUP BY id)
SELECT id, place, round(value / norm, 6) AS value FROM v JOIN l USING (id) WHERE abs(value) > 1e-9""")
def text_vectors(x):
    """Vectors of weighted, hashed words of every document, place by place."""
    texts = x.raw("documents").select(F.col("doc_id").alias("id"), "text")
    words = retrieval.counted(texts)
    return retrieval.hashed(texts, retrieval.dictionary(texts, words=words), words=words).withColumn("value", F.round("value", 6))


def _questions(x):
    return x.chunks().filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))


@query("", """WITH q AS (SELECT vec_id AS query_id, embedding AS v, label AS l FROM embeddings WHERE vec_id % 100 = 0), d AS (SELECT query_id, vec_id AS id, l, label, round(list_cosine_distance(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])), 6) AS distance FROM embeddings, q), k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 10), z AS (SELECT query_id, id, round(1 - distance + CASE WHEN label = l THEN 0.5 ELSE 0 END, 6) AS score FROM k)
SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM z QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5""")
def hybrid_retrieval(x):
    hits = retrieval.search(x.chunks(), _questions(x))
    label = lambda c, to: x.chunks().select(F.col("id").alias(c), F.col("label").alias(to))
    near = hits.join(label("id", "own"), "id").join(label("query_id", "asked"), "query_id").filter("own = asked").select("query_id", "id")
    return retrieval.merged(hits, near)


# Logs, the store and the stream.


@query("v c", "SELECT c.commit_hash AS hash, c.author, 'subject of ' || c.commit_hash AS message, (SELECT string_agg(DISTINCT file_path, ',' ORDER BY file_path) FROM v WHERE v.commit_hash = c.commit_hash) AS files FROM c")
def parsed_log(x):
    """A log's records, as git writes them, back to commits."""
    part = git.PART.replace("%x00", "\0")
    files = x.versions().groupBy("commit_hash").agg(F.concat_ws("\n", F.sort_array(F.collect_list("file_path"), asc=False)).alias("lines"))
    head = F.concat(F.lit(git.MARK), F.concat_ws(part, "commit_hash", "author", "author", F.unix_timestamp("ts").cast("string"), F.concat(F.lit("subject of "), "commit_hash")))
    written = x.commits().join(files, "commit_hash", "left").select(F.concat(head, F.lit("\n\n"), F.coalesce("lines", F.lit("")), F.lit("\n")).alias("record"))
    return git.parse_log(written).select("hash", "author", "message", F.array_join("files", ",").alias("files"))


def _store(x) -> Store:
    return Store(x.spark, f"{shared_dir(x.spark)}/store-{uuid.uuid4().hex}")


@query("f", "SELECT 'r' || (file_id % 3) AS repo_id, path, CASE WHEN file_id % 2 = 0 THEN 'changed' ELSE 'first' END AS language FROM f WHERE file_id % 3 <> 1 UNION ALL SELECT 'r1', 'new/' || file_id, 'third' FROM f WHERE file_id % 3 = 1")
def stored_files(x):
    """Three repositories in the store: an upsert of some of their files, a repository deleted, and its part written anew."""
    store, rows = _store(x), x.paths().select(F.concat(F.lit("r"), (F.col("file_id") % 3).cast("string")).alias("repo_id"), "path", F.lit("first").alias("language"), "file_id")
    store.upsert("files", rows.drop("file_id"))
    store.upsert("files", rows.filter("file_id % 2 = 0").withColumn("language", F.lit("changed")).drop("file_id"))
    store.delete("files", repo_id="r1")
    anew = rows.filter("repo_id = 'r1'").select("repo_id", F.concat(F.lit("new/"), F.col("file_id").cast("string")).alias("path"), F.lit("third").alias("language"))
    store.append_new("files", anew)
    store.append_new("files", anew)
    return store.read("files").select("repo_id", "path", "language")


@query("v", "SELECT DISTINCT file_path, hash, commit_hash FROM v")
def tracked_versions(x):
    """Versions that arrive as a stream, each in the store once."""
    store, place = _store(x), f"{shared_dir(x.spark)}/stream-{uuid.uuid4().hex}"
    x.versions().write.parquet(f"{place}/in")
    stream.track(stream.unique(stream.read(x.spark, f"{place}/in")), store, f"{place}/state").awaitTermination()
    return store.read("file_versions").select("file_path", "hash", "commit_hash")


@query("v", """WITH x AS (SELECT file_path, hash, commit_hash, author, lag(hash) OVER w AS previous_hash, row_number() OVER w AS n FROM v WINDOW w AS (PARTITION BY file_path ORDER BY ts, hash))
SELECT file_path, hash, commit_hash, author, previous_hash, CASE WHEN n = 1 THEN 'first' WHEN hash = previous_hash THEN 'same' ELSE 'changed' END AS change FROM x""")
def streamed_history(x):
    """Every version with the one before it, by the state that a stream keeps of each file."""
    place = f"{shared_dir(x.spark)}/stream-{uuid.uuid4().hex}"
    x.versions().write.parquet(f"{place}/in")
    stream.follow(stream.read(x.spark, f"{place}/in", files=1_000_000), f"{place}/out", f"{place}/state").awaitTermination()
    return x.spark.read.schema(stream.LINEAGE).parquet(f"{place}/out").select("file_path", "hash", "commit_hash", "author", "previous_hash", "change")


# Source files.


def _sources(x):
    """A small Python file for each document."""
    n = lambda c: (c % fixtures.FUNCTIONS).cast("string")
    rows = x._ids()
    i = F.col("file_id")
    content = F.concat(F.lit("import "), fixtures._pick(fixtures.EXTERNAL, i), F.lit("\nfrom "), "dir", F.lit(" import "), "stem", F.lit("\n\nclass C"), i.cast("string"), F.lit(":\n    pass\n\ndef fn_"), n(i), F.lit("(x):\n    return fn_"), n(3 * i + 1), F.lit("(x)\n\ntop = 1\n"))
    return rows.select("path", F.lit("python").alias("language"), content.alias("content"))


def _scripts(x):
    """A small JavaScript file for each document, with strings, a template literal, a comment and a regular expression that hold quotes."""
    n = lambda c: (c % fixtures.FUNCTIONS).cast("string")
    i = F.col("file_id")
    content = F.concat(
        F.lit("import x from '"), fixtures._pick(fixtures.EXTERNAL, i), F.lit("';\nimport {\n"), F.repeat(F.lit("  a,\n"), 120), F.lit("} from \""), "stem", F.lit("\";\n// it's no call()\nclass C"), i.cast("string"),
        F.lit(" {}\nfunction fn_"), n(i), F.lit("(x) {\n  const q = /[\"'/]+/g;\n  return `${fn_"), n(3 * i + 1), F.lit("(x)} not()`;\n}\nhelper('no()');\n"),
    )
    return x._ids().select("path", F.lit("javascript").alias("language"), content.alias("content"))


_FN = f"'fn_' || (file_id % {fixtures.FUNCTIONS})"
_CALL = f"'fn_' || ((3 * file_id + 1) % {fixtures.FUNCTIONS})"


@query("f", f"SELECT path AS file, {_FN} AS name, 7 AS line FROM f")
def parsed_functions(x):
    return parser.tables(parser.parse(_sources(x)))["functions"]


@query("f", f"SELECT path AS file, {_FN} AS name, 7 AS line FROM f")
def functions_by_sql(x):
    """The same in SQL: the parser is a table function that each file's row goes through."""
    parser.register(x.spark)
    _sources(x).createOrReplaceTempView("lodestone_sources")
    return x.spark.sql("SELECT s.path AS file, p.name, max_by(p.line, p.pos) AS line FROM lodestone_sources AS s, LATERAL parse_source(s.language, s.content) AS p WHERE p.kind = 'function' GROUP BY s.path, p.name")


@query("f", f"SELECT path AS file, {_FN} AS caller, {_CALL} AS callee FROM f")
def parsed_calls(x):
    return parser.tables(parser.parse(_sources(x)))["function_calls"]


@query("f", f"SELECT path AS file, unnest([0, 1, 2]) AS pos, unnest([{_pick(fixtures.EXTERNAL, 'file_id')}, dir, stem]) AS module FROM f")
def parsed_imports(x):
    return parser.tables(parser.parse(_sources(x)))["imports"]


@query("f", "SELECT path AS file, 'C' || file_id AS name, 4 AS line FROM f")
def parsed_classes(x):
    return parser.tables(parser.parse(_sources(x)))["classes"]


@query("f", f"SELECT path AS file, {_CALL} AS callee FROM f")
def parsed_file_calls(x):
    return parser.tables(parser.parse(_sources(x)))["file_calls"]


@query("f", f"SELECT path AS file, {_FN} AS name, 126 AS line FROM f")
def script_functions(x):
    return parser.tables(parser.parse(_scripts(x)))["functions"]


@query("f", f"SELECT path AS file, unnest([0, 1]) AS pos, unnest([{_pick(fixtures.EXTERNAL, 'file_id')}, stem]) AS module FROM f")
def script_imports(x):
    return parser.tables(parser.parse(_scripts(x)))["imports"]


@query("f", f"SELECT path AS file, {_CALL} AS callee FROM f UNION ALL SELECT path, 'helper' FROM f")
def script_file_calls(x):
    return parser.tables(parser.parse(_scripts(x)))["file_calls"]


@query("f", f"SELECT path AS file, {_FN} AS caller, {_CALL} AS callee FROM f")
def script_calls(x):
    return parser.tables(parser.parse(_scripts(x)))["function_calls"]


@query("f", f"SELECT path AS file, 'File: ' || path || chr(10) || 'Class C' || file_id || ' at line 4' || chr(10) || 'Function ' || {_FN} || ' at line 7' || chr(10) || 'Imports: ' || {_pick(fixtures.EXTERNAL, 'file_id')} || ', ' || dir || ', ' || stem AS text FROM f")
def embedding_texts(x):
    return retrieval.embedding_text(parser.parse(_sources(x)))


@query("f", f"SELECT path AS file, 'def ' || {_FN} || '(x):' || chr(10) || '    return ' || {_CALL} || '(x)' || chr(10) AS code FROM f")
def function_bodies(x):
    return _sources(x).select(F.col("path").alias("file"), parser.body(F.col("content"), F.lit(7)).alias("code"))


@query("t reach imp_fn", f"SELECT target, 'MODIFY: Affects ' || total || ' files with ' || level || ' risk.' AS explanation FROM ({_blast('modify')})", True)
def impact_explanations(x):
    found = impact.blast_radius(x.edges(), targets(x), x.functions(), x.file_calls())
    return found.select("target", reports.impact_text(F.lit("modify"), F.col("total"), F.col("level")).alias("explanation"))


@query("f e", """WITH d AS (SELECT dir, count(*) AS n FROM f GROUP BY dir ORDER BY n DESC, dir LIMIT 10)
SELECT 'Files: ' || (SELECT count(*) FROM f) || chr(10) || 'Dependencies: ' || (SELECT count(*) FROM e) || chr(10) || 'Directories:' || chr(10) || (SELECT string_agg('- ' || dir || ': ' || n || ' files', chr(10) ORDER BY n DESC, dir) FROM d) AS text""")
def graph_context(x):
    return reports.graph_context(x.paths(), x.edges())


@query("f e nodes pat cc", """WITH d AS (SELECT dir, count(*) AS n FROM f GROUP BY dir ORDER BY n DESC, dir LIMIT 8), m AS (SELECT (SELECT count(*) FROM (SELECT path FROM f UNION SELECT node FROM nodes)) AS total_files, (SELECT count(*) FROM e) AS total_dependencies)
SELECT total_files, total_dependencies, round(round(total_dependencies / greatest(total_files, 1), 6), 2) AS avg_coupling, (SELECT cycles FROM cc) AS cycles, (SELECT truncated FROM cc) AS cycles_truncated, (SELECT string_agg(pattern, ', ' ORDER BY pattern) FROM pat WHERE detected) AS patterns, (SELECT string_agg(dir || ' (' || n || ')', ', ' ORDER BY n DESC, dir) FROM d) AS top_directories FROM m""", True)
def architecture_stats(x):
    return reports.architecture_stats(x.paths(), x.edges())
