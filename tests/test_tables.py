import os
import re

import pytest

from lodestone.functions import paths
from lodestone.operators import projections, resolve, retrieval, snapshots, versions
from lodestone.shared import shared_dir
from lodestone.sources import parser
from lodestone.sources.store import Store
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    "path, want",
    [
        ("/tmp/r/src/a.py", "src/a.py"),
        ("C:\\Users\\u\\r\\backend\\a.py", "backend/a.py"),
        ("/tmp/a.py", "/tmp/a.py".split("/", 1)[0] + "/tmp/a.py"),
        ("/tmp/x/y/z.py", "x/y/z.py"),
        ("lib/a.py", "lib/a.py"),
        ("/home/u/src/a.py", "/home/u/src/a.py"),
    ],
)
def test_canonical_paths(spark, path, want):
    got = spark.createDataFrame([(path,)], "p string").select(paths.canonical(F.col("p"))).first()[0]
    assert got == (want if path != "/tmp/a.py" else "/tmp/a.py")


def test_path_parts(spark):
    rows = spark.createDataFrame([("/a/b/.env",), ("x.tar.gz",), ("a\\b\\c.py",), ("/r/node_modules/x.js",)], "p string")
    p = F.col("p")
    got = [tuple(r) for r in rows.select(paths.name(p), paths.stem(p), paths.extension(p), paths.parent(p), paths.label(p), paths.included(p)).collect()]
    assert got == [(".env", ".env", "", "b", "b/.env", True), ("x.tar.gz", "x.tar", ".gz", None, "x.tar.gz", True), ("c.py", "c", ".py", "b", "b/c.py", True), ("x.js", "x", ".js", "node_modules", "node_modules/x.js", False)]


def resolved_plainly(files, imports):
    """By a list of all names in the order in which files are scanned."""
    table = []
    for ext in (".py", ".js", ".java"):
        for path in sorted(f for f in files if f.endswith(ext)):
            bare = path.rsplit("/", 1)[-1][: -len(ext)]
            table += [(bare, path), (f"./{bare}", path), (f"../{bare}", path)]
            pieces = re.findall(r"^/|[^/]+", path)
            for k in (3, 2, 1):
                if len(pieces) >= max(2, k):
                    table.append((re.sub(r"\.(py|java|js)", "", "/".join(pieces[-k:])), path))
    holder = dict(table)

    def target(module):
        if module in holder:
            return holder[module]
        fitting = [name for name, _ in table if module.endswith(name) or name.endswith(module)]
        return holder[fitting[0]] if fitting else None

    return {(file, module, "external") if target(module) in (None, file) else (file, target(module), "imports") for file, module in imports}


def test_import_resolution(spark):
    files = ["/r/a/util.py", "/r/b/util.py", "/r/b/photos.py", "/r/c/main.js", "/r/c/Util.java", "/r/c/self.py", "top.py", "/r/a/deep/er/mod.py"]
    imports = [("/r/a/util.py", m) for m in ("util", "./util", "../util", "os", "react", "pkg.mod", "er/mod", "main", "b/util", "self")] + [("/r/c/self.py", "self"), ("top.py", "util"), ("top.py", "util"), ("top.py", "c/Util")]
    f = spark.createDataFrame([(x,) for x in files], "path string")
    i = spark.createDataFrame([(a, k, b) for k, (a, b) in enumerate(imports)], "file string, pos int, module string")
    got = {tuple(r) for r in resolve.resolve_imports(f, i).collect()}
    assert got == resolved_plainly(files, imports)
    assert ("/r/a/util.py", "/r/b/photos.py", "imports") in got
    assert ("/r/a/util.py", "/r/b/photos.py") not in {tuple(r) for r in resolve.import_targets(f, i).collect()}


def test_callers_are_merged(spark):
    a = spark.createDataFrame([("f", "x.py", "g")], "name string, file string, caller string")
    b = spark.createDataFrame([("f", "x.py"), ("f", "y.py")], "name string, file string")
    assert sorted(map(tuple, resolve.merged_callers(a, b).collect()), key=str) == [("f", "x.py", "g"), ("f", "y.py", None)]


def test_versions(spark):
    rows = [("r", "a", "h1", "c1", 1, "u"), ("r", "a", "h1", "c2", 2, "u"), ("r", "a", "h2", "c3", 3, "v"), ("r", "b", "h9", "c3", 3, "v")]
    v = spark.createDataFrame(rows, "repo_id string, file_path string, hash string, commit_hash string, ts long, author string")
    history = versions.file_history(v)
    assert history.filter("previous_hash IS NOT NULL").count() == 2
    assert [tuple(r) for r in versions.changed_versions(v).select("file_path", "hash", "previous_hash").collect()] == [("a", "h2", "h1")]
    assert [tuple(r) for r in versions.contributors(v).collect()] == [("u", 1, 2), ("v", 2, 2)]
    now = spark.createDataFrame([("a", "h2"), ("b", "other"), ("c", "x")], "file_path string, hash string")
    assert {tuple(r) for r in versions.tampered(v, now).collect()} == {("a", "intact"), ("b", "tampered"), ("c", "not_tracked")}
    scanned = spark.createDataFrame([("r", "a", "h2", "c3"), ("r", "a", "h2", "c4"), ("r", "z", None, "c4")], "repo_id string, file_path string, hash string, commit_hash string")
    assert [r["commit_hash"] for r in versions.new_versions(v, scanned).collect()] == ["c4"]
    elsewhere = now.limit(1).withColumn("repo_id", F.lit("other"))
    assert [r["status"] for r in versions.tampered(v, elsewhere).collect()] == ["not_tracked"]
    ab = {tuple(r) for r in versions.compare_commits(v, "c2", "c3").collect()}
    ba = {tuple(r) for r in versions.compare_commits(v, "c3", "c2").collect()}
    assert ab == {("a", "modified"), ("b", "added")} and ba == {("a", "modified"), ("b", "removed")}
    commits = spark.createDataFrame([("r", f"c{i}", i, "u", f"m{i}") for i in (3, 1, 2)], "repo_id string, commit_hash string, ts long, author string, message string")
    assert {tuple(r) for r in versions.commit_lineage(commits).collect()} == {("r", "c2", "c1"), ("r", "c3", "c2")}


def test_snapshot_comparison(spark):
    files = [("s1", f"/tmp/r/src/f{i}.py", f"h{i}") for i in range(3)] + [("s2", f"/tmp/q/src/f{i}.py", f"h{i}" if i > 1 else None if i else "new") for i in range(14)]
    f = spark.createDataFrame(files, "snapshot_id string, path string, hash string")
    s = spark.createDataFrame([("s1", "r", "abc1", 3, 5, 1.0, 0), ("s2", "r", "abd2", 14, 9, 2.5, 1)], "snapshot_id string, repo_id string, commit_hash string, total_files long, total_deps long, avg_coupling double, cycle_count long")
    row = snapshots.compare(s, f, "s1", "s2").first()
    assert (row["added"], row["removed"], row["modified"], row["coupling_delta"], row["risk_areas"], row["level"]) == (11, 0, 1, 1.5, 3, "high")
    assert row["summary"] == "11 files added; 1 files modified; coupling increased; 1 new cycles"
    same = snapshots.compare(s, f, "s1", "s1").first()
    assert same["summary"] == "No significant changes detected" and same["level"] == "low"
    p = spark.createDataFrame([("s1", "mvc", True, 0.5), ("s2", "mvc", True, 0.9), ("s2", "layered", True, 0.6)], "snapshot_id string, pattern string, detected boolean, confidence double")
    c = spark.createDataFrame([("s1", "a"), ("s2", "a"), ("s2", "b")], "snapshot_id string, file string")
    full = snapshots.compare(s, f, "s1", "s2", p, c).first()
    assert (full["risk_areas"], full["high_coupling_before"], full["high_coupling_after"]) == (4, 1, 2)
    assert full["pattern_changes"] == "layered: newly_detected; mvc: confidence_changed: +0.40" and full["summary"].endswith("; 2 pattern changes")
    assert full["risks"] == "+11 files; coupling +1.50; +1 cycles; +1 highly coupled files"
    risks = spark.createDataFrame([("/r/src/f0.py", 40, "medium"), ("/r/a/f1.py", 90, "critical"), ("src/f1.py", 0, "low")], "file string, score long, level string")
    assert [tuple(r) for r in snapshots.riskiest(risks, spark.createDataFrame([("src/f0.py",), ("src/f1.py",), ("gone",)], "file string")).collect()] == [("src/f0.py", 40, "medium")]
    assert snapshots.compare(s, f, "s1", "nope").count() == 0
    assert snapshots.compare_architecture(s, "abc", "abd").first()["level"] == "high"


def test_search_and_boost(spark):
    chunks = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(12)], "id int, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, vector array<float>")
    hits = retrieval.search(chunks, q)
    assert [r["id"] for r in hits.orderBy("rank").collect()] == list(range(10))
    near = spark.createDataFrame([(0, 9), (0, 11)], "query_id int, id int")
    assert [r["id"] for r in retrieval.merged(hits, near).orderBy("rank").collect()] == [9, 0, 1, 2, 3]


def test_a_rare_word_decides(spark):
    texts = spark.createDataFrame([(0, "a b c"), (1, "c, B a"), (2, ""), (3, "the list the list sort"), (4, "the list zebra"), (5, None), *[(10 + i, f"the list of things {i}") for i in range(30)]], "id long, text string")
    terms = retrieval.dictionary(texts)
    weight = {r["word"]: r["weight"] for r in terms.collect()}
    assert weight["zebra"] > weight["of"] > weight["the"] and weight[""] > weight["zebra"]
    made = {r["id"]: r["embedding"] for r in retrieval.embed(texts, terms, size=4096).collect()}
    assert made[0] == made[1] and sum(map(abs, made[2])) == sum(map(abs, made[5])) == 0 and abs(sum(x * x for x in made[4]) - 1) < 1e-5 and len(made) == 36
    asked = spark.createDataFrame([(0, "the list of the zebra")], "query_id long, text string")
    q = retrieval.embed(asked, terms, "query_id", size=4096).select("query_id", F.col("embedding").alias("vector"))
    chunks = spark.createDataFrame([(i, v) for i, v in made.items() if any(v)], "id long, embedding array<float>")
    assert retrieval.search(chunks, q).filter("rank = 1").first()["id"] == 4


PYTHON = """import os, a.b, numpy as np
from x.y import one, two as deux
from . import near
from z import *

class K(object):
    def m(self):
        # a comment
        self.go(helper())

        def inner():
            deep()
        return inner

async def top():
    K().m()
x = top
"""
JAVASCRIPT = """import React from 'react';
import './style.css'; // import 'no'
function outer(a) {
  const s = "function no() {}";
  if (a) { helper(a); }
  function inside() { this.api.load(); }
}
const f = () => outer(1);
"""


SCRIPT = """import {
""" + "  a,\n" * 150 + """} from './many';
const text = `x ${call(`in ${deep({ a: 1 })}`)} not()`;
const rx = /[/"'`]no()/g, half = total() / 2 / more();
function outer() { return /"no()'/.test(name()) ? `${inner()}` : "no()"; }
import('lazy');
"""


def test_scripts_with_templates_and_regular_expressions():
    got = parser.parse_javascript(SCRIPT)
    assert got["imports"] == ["./many"]
    assert got["function_calls"] == ["call", "deep", "total", "more", "test", "name", "inner"]
    assert got["functions"] == [{"name": "outer", "line": 155}]
    assert got["function_to_function_calls"] == [{"caller": "outer", "callee": c} for c in ("test", "name", "inner")]
    assert parser.parse_javascript("`${a(`")["function_calls"] == ["a"] and parser.parse_javascript("x = a / b(1) / c(2)")["function_calls"] == ["b", "c"]


def test_function_calls_from_their_own_file(spark):
    calls = spark.createDataFrame([("a.py", "f", "g"), ("a.py", "f", "g")], "file string, caller string, callee string")
    own = spark.createDataFrame([("f", "a.py"), ("f", "b.py"), ("g", "b.py"), ("g", "c.py")], "name string, file string")
    assert sorted(map(tuple, resolve.resolve_function_calls(calls, own).collect())) == [("a.py::f", "b.py::g"), ("a.py::f", "c.py::g")]


def test_search_in_blocks(spark):
    chunks = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(30)], "id int, embedding array<float>")
    q = spark.createDataFrame([(k, [1.0, k / 10]) for k in range(7)], "query_id int, vector array<float>")
    whole = sorted(map(tuple, retrieval.search(chunks, q).collect()))
    assert len(whole) == 70 and sorted(map(tuple, retrieval.search(chunks, q, block=2).collect())) == whole
    assert retrieval.search(chunks, q.limit(0)).count() == 0


FILE_ROWS = "repo_id string, path string, language string"


def test_store_writes_parts(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = lambda *some: spark.createDataFrame(list(some), FILE_ROWS)
    with pytest.raises(FileNotFoundError):
        store.read("files")
    store.upsert("files", rows(("1", "a", "x"), ("2", "a", "x"), ("2", "a", "y")))
    assert sorted(map(tuple, store.read("files").collect())) == [("1", "a", "x"), ("2", "a", "y")]
    before = store._state("files")[1]["parts"][store._part("files", "2")]
    store.upsert("files", rows(("1", "a", "z"), ("1", "b", "x")))
    assert store._state("files")[1]["parts"][store._part("files", "2")] == before
    assert sorted(map(tuple, store.read("files", "1").collect())) == [("1", "a", "z"), ("1", "b", "x")]
    assert store.delete("files", repo_id="1", path="a") == 1 and [r["path"] for r in store.read("files", "1").collect()] == ["b"]
    assert store.append_new("files", rows(("1", "a", "back"), ("1", "b", "no"))) == 1
    assert sorted(map(tuple, store.read("files", "1").collect())) == [("1", "a", "back"), ("1", "b", "x")]
    store.replace("files", "1", rows(("1", "c", "x")).limit(0))
    assert store.read("files", "1").count() == 0 and store.read("files").count() == 1 and store.read("files", "none").count() == 0
    assert store.exists("files", "1") and not store.exists("files", "none") and not store.exists("classes")
    assert store.append_new("files", rows(("2", "a", "q"), ("3", "n", "x"))) == 1 and store.delete("files", repo_id="2") == 1
    # Columns that come later are null before.
    store.append_new("files", rows(("4", "w", "x")).withColumn("more", F.lit(1)))
    assert sorted(map(tuple, store.read("files", "3", "4").collect())) == [("3", "n", "x", None), ("4", "w", "x", 1)]
    store.vacuum("files", 0)
    assert sorted(r["repo_id"] for r in store.read("files").collect()) == ["3", "4"]
    assert sum(p.name.startswith("data-") for p in (tmp_path / "files").iterdir()) == 2


def test_an_append_writes_its_own_rows(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    data = lambda: {p: p.stat().st_size for p in (tmp_path / "files").rglob("*.parquet")}
    many = spark.range(200_000).select(F.lit("r").alias("repo_id"), F.concat(F.lit("path"), F.sha2(F.col("id").cast("string"), 256)).alias("path"), F.lit("x").alias("language"))
    store.upsert("files", many)
    before = data()
    for k in range(3):
        assert store.append_new("files", spark.createDataFrame([("r", f"n{k}", "x"), ("r", "n0", "x")], FILE_ROWS)) == 1
    store.upsert("files", spark.createDataFrame([("r", "n1", "y")], FILE_ROWS))
    assert store.delete("files", repo_id="r", path="n2") == 1
    new = {p: n for p, n in data().items() if p not in before}
    assert len(new) == 5 and sum(new.values()) < sum(before.values()) / 100 and store.read("files").count() == 200_002
    # Appended layers have new keys, so reading them shuffles nothing; covered ones are put over each other.
    plan = store.read("files")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan
    store.compact("files")
    plan = store.read("files")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and store.read("files").filter("path = 'n1' and language = 'y'").count() == 1 and store.read("files").count() == 200_002


def test_layers_are_merged_by_size(spark, tmp_path):
    """Rows are written again about as often as the logarithm of their number says, and a part never has many layers."""
    store, written, want = Store(spark, str(tmp_path)), 0, {}
    for k in range(40):
        rows = [("r", f"f{(k * 7 + j) % 50}", f"{k}") for j in range(3)]
        want |= {r[1]: r[2] for r in rows}
        store.upsert("files", spark.createDataFrame(rows, FILE_ROWS))
        if k % 9 == 4:
            gone = f"f{(k * 7 + 1) % 50}"
            assert store.delete("files", repo_id="r", path=gone) == 1
            want.pop(gone)
        (layers,) = store._state("files")[1]["parts"].values()
        assert len(layers) <= 8
    assert {r["path"]: r["language"] for r in store.read("files").collect()} == want
    assert any(p.name.endswith(".all") for p in (tmp_path / "files" / "log").iterdir())


def test_writers_of_one_part_conflict(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = lambda *some: spark.createDataFrame(list(some), FILE_ROWS)
    store.upsert("files", rows(("1", "a", "x"), ("2", "a", "x")))
    base, state = store._state("files")
    store.upsert("files", rows(("1", "b", "x")))
    # A writer that began before: another part goes on top, the same part fails, and nothing is lost.
    store._add("files", base, state, rows(("2", "b", "x")), True)
    with pytest.raises(RuntimeError, match="another writer"):
        store._add("files", base, state, rows(("1", "c", "x")), True)
    assert sorted((r["repo_id"], r["path"]) for r in store.read("files").collect()) == [("1", "a"), ("1", "b"), ("2", "a"), ("2", "b")]
    # An entry whose writer is still at it is not read; one whose writer died is passed over.
    entry = tmp_path / "files" / "log" / "00000004.json"
    entry.write_text("")
    (tmp_path / "files" / "log" / ".00000004.json.crc").unlink(missing_ok=True)
    with pytest.raises(RuntimeError):
        store.upsert("files", rows(("1", "d", "x")))
    os.utime(entry, (1, 1))
    store.upsert("files", rows(("1", "d", "x")))
    assert store.read("files", "1").count() == 3


def test_the_shared_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")

    class Cluster:
        """A session on a cluster without a folder."""

        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "spark://somewhere:7077"

            class _jsc:
                class _Sc:
                    class _None:
                        isDefined = staticmethod(lambda: False)

                    getCheckpointDir = staticmethod(lambda: Cluster.sparkContext._jsc._Sc._None)

                sc = staticmethod(lambda: Cluster.sparkContext._jsc._Sc)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Cluster)


def test_analysis_links(spark):
    log = spark.createDataFrame([("r", "c1", 1), ("r", "c1", 2), ("r", "c2", 3), ("r", "c1", 4), ("q", "c9", 1)], "repo_id string, commit_hash string, ts long")
    assert sorted(map(tuple, versions.analysis_links(log).collect())) == [("r", "c1", "c2"), ("r", "c2", "c1")]


def test_parser(spark):
    rows = [("a.py", "python", PYTHON), ("b.js", "javascript", JAVASCRIPT), ("c.java", "java", "class X {}"), ("d.py", "python", "def broken(:"), ("e.py", "python", None)]
    parsed = parser.parse(spark.createDataFrame(rows, "path string, language string, content string"))
    got = {r["file"]: r for r in parsed.collect()}
    a, b = got["a.py"], got["b.js"]
    assert [c["name"] for c in a["classes"]] == ["K"] and [(f["name"], f["line"]) for f in a["functions"]] == [("m", 7), ("inner", 11), ("top", 15)]
    assert a["imports"] == ["os", "a.b", "x.y", "one", "near", "z"] and a["function_calls"] == ["go", "helper", "deep", "m", "K"]
    calls = {(c["caller"], c["callee"]) for c in a["function_to_function_calls"]}
    assert calls == {("m", "go"), ("m", "helper"), ("m", "deep"), ("inner", "deep"), ("top", "m"), ("top", "K")}
    assert b["imports"] == ["react", "./style.css"] and [(f["name"], f["line"]) for f in b["functions"]] == [("outer", 3), ("inside", 6)]
    assert b["function_calls"] == ["helper", "load", "outer"] and {(c["caller"], c["callee"]) for c in b["function_to_function_calls"]} == {("outer", "helper"), ("inside", "load"), ("outer", "load")}
    assert not any(got[f]["functions"] for f in ("c.java", "d.py", "e.py"))
    code = spark.createDataFrame([(PYTHON,)], "c string").select(parser.body(F.col("c"), F.lit(7)), parser.body(F.col("c"), F.lit(15)), parser.body(F.lit("def f():\n" + "  x\n" * 80), F.lit(1)), parser.body(F.col("c"), F.lit(900))).first()
    assert code[0].split("\n")[0] == "    def m(self):" and code[0].rstrip().endswith("return inner") and code[1] == "async def top():\n    K().m()"
    assert code[2].endswith("... (truncated)") and code[2].count("\n") == 50 and code[3] is None
    text = {r["file"]: r["text"] for r in retrieval.embedding_text(parsed).collect()}
    assert text["c.java"] == "File: c.java" and text["b.js"].endswith("Imports: react, ./style.css")


def test_resolved_path(spark):
    f = spark.createDataFrame([("/r/b/x.py",), ("/r/a/x.py",), ("/r/a/y.py",)], "path string")
    asked = spark.createDataFrame([("/r/b/x.py",), ("b/x.py",), ("x.py",), ("q/y.py",), ("none.py",)], "asked string")
    assert {tuple(r) for r in projections.resolved_path(asked, f).collect()} == {("/r/b/x.py", "/r/b/x.py"), ("b/x.py", "/r/b/x.py"), ("x.py", "/r/a/x.py"), ("q/y.py", "/r/a/y.py"), ("none.py", "none.py")}
