import hashlib
import os
import subprocess
import sys
import time

import duckdb
import pytest

import __spark_entry__ as entry
from lodestone.plans import queries as own
from lodestone.plans import reports
from lodestone.plans.api import Api
from lodestone.sources import git
from lodestone.streaming import versions as stream
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    connection.sql("SET timezone = 'UTC'")
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def plain(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query_against_sql(spark, oracle, name):
    df = own.QUERIES[name](spark, SF)
    want = oracle.sql(own.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in df.columns]
    key = lambda rows: sorted((tuple(map(plain, r)) for r in rows), key=repr)
    assert key(df.collect()) == key([r[i] for i in order] for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_training_operators():
    """The engine's queries are there whatever keeps the other operators from being imported."""
    for hidden in ("xxhash", "lodestone.llm", "corpus_pipeline"):
        code = f"import sys; sys.modules[{hidden!r}] = None; import __spark_entry__ as e; q = e.queries(); assert 'structural_risk' in q and set(e.oracle_sql()) <= set(q), q; print(len(q))"
        done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(entry.__file__))
        assert done.returncode == 0, done.stderr


@pytest.fixture
def repository(tmp_path):
    root = tmp_path / "origin" / "shop"
    (root / "src" / "services").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "node_modules" / "x.js").write_text("function no() {}\n")
    (root / "src" / "app_controller.py").write_text("from services.order_service import place\nimport os\n\ndef main():\n    place(1)\n")
    (root / "src" / "services" / "order_service.py").write_text("import item_model\n\ndef place(n):\n    return check(n)\n\ndef check(n):\n    return n\n")
    (root / "src" / "item_model.py").write_text("class Item:\n    pass\n")
    commit = lambda m: subprocess.run(["git", "-c", "user.email=a@b", "-c", "user.name=A B", "-C", str(root), "commit", "-qam", m], check=True)
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    (root / ".gitignore").write_text("node_modules\n")
    subprocess.run(["git", "-C", str(root), "add", "."], check=True)
    commit("first | with a bar")
    (root / "src" / "item_model.py").write_text("class Item:\n    x = 1\n")
    commit("second")
    return root


def test_analysis_of_a_repository(spark, repository, tmp_path):
    api = Api(spark, str(tmp_path / "store"))
    job = api.analyze(f"file://{repository}", workspace=str(tmp_path / "work"))
    state = api.status(job)
    assert state["status"] == "completed", state
    repo = state["result"]["repo_id"]
    assert api.status("none")["status"] == "not_found" and api.load(repo) and not api.load("other")
    root = str(tmp_path / "work" / "shop")
    files = [r["path"][len(root) + 1 :] for r in api.files(repo).collect()]
    assert files == ["src/app_controller.py", "src/item_model.py", "src/services/order_service.py"]
    edges = {(r["source"][len(root) + 1 :], r["target"][len(root) + 1 :]) for r in api.graph_data(repo)[1].collect()}
    assert ("src/app_controller.py", "src/services/order_service.py") in edges and ("src/services/order_service.py", "src/item_model.py") in edges
    hit = api.impact(repo, "order_service.py", "delete").first()
    assert hit["direct"] == 1 and hit["functions"] == 2 and hit["callers"] == 1 and hit["explanation"].startswith("DELETE: Affects 1 files")
    assert [p.rpartition("/")[2] for p in hit["direct_dependents"]] == ["app_controller.py"] and hit["indirect_dependents"] == [] and hit["functions_affected"] == ["check", "place"]
    assert [p.rpartition("/")[2] for p in hit["function_callers"]] == ["app_controller.py"] and hit["structural_score"] == hit["fan_in_pts"] + hit["fan_out_pts"] == 8 * hit["fan_in"] + 5 * hit["fan_out"]
    assert [r["name"] for r in api.functions(repo).collect()] == ["main", "place", "check"]
    own_function = api.function(repo, "place").first()
    assert own_function["callers"] == [f"{root}/src/app_controller.py::main"] and len(own_function["related"]) == 3 and api.call_chain(repo, "place").count() == 1
    service = f"{root}/src/services/order_service.py"
    between = {(r["source"], r["target"]) for r in api.function_graph(repo)[1].collect()}
    assert between >= {(f"{root}/src/app_controller.py::main", f"{service}::place"), (f"{service}::place", f"{service}::check")}
    assert {(r["src"].rpartition(":")[2], r["dst"].rpartition(":")[2], r["dist"]) for r in api.function_closure(repo).collect()} == {("main", "place", 1), ("main", "check", 2), ("place", "check", 1)}
    assert api.search(repo, "order service place check", context="item_model.py").count() == 3
    assert {r["pattern"] for r in api.patterns(repo).filter("detected").collect()} >= {"mvc"}
    assert all(r["failure_scenario"] for r in api.confidence_report(repo)[0].collect()) and tuple(api.coupling(repo)[3].first()) == (0, False)
    assert api.confidence_report(repo)[1].first()["total"] >= 1 and api.coupling(repo)[0].first()["total_files"] >= 3
    text = api.architecture(repo)
    assert "files with" in text["macro"] and Api(spark, str(tmp_path / "store"), writer=lambda _: "never asked").architecture(repo) == text and api.repositories().first()["file_count"] == 3
    assert api.dependencies(repo, "app_controller.py").first()["modules"] == ["os", "place", "services.order_service"]
    again = api.status(api.analyze(f"file://{repository}", root=root))["result"]
    assert again["cached"] and again["snapshot_id"] == state["result"]["snapshot_id"]
    snapshot = api.snapshots(repo).collect()
    assert [s["file_count"] for s in snapshot] == [3] and api.compare_snapshots(snapshot[0]["snapshot_id"], snapshot[0]["snapshot_id"]).first()["level"] == "low"
    head = git.head(spark, root).first()["commit_hash"]
    old_edges, old_metrics = api.commit_state(repo, head)
    assert old_edges.count() >= 3 and old_metrics.first()["total_files"] >= 3 and api.commit_state(repo, "none")[1].count() == 0
    with open(f"{root}/src/view_page.py", "w") as f:
        f.write("import item_model\nimport app_controller\n")
    later = api.analyze(f"file://{repository}", root=root, wait=False)
    assert api.status(later)["status"] in ("processing", "completed")
    while api.status(later)["status"] == "processing":
        time.sleep(0.2)
    later = api.status(later)["result"]
    assert not later["cached"]
    pair = state["result"]["snapshot_id"], later["snapshot_id"]
    assert {r["status"] for r in api.changed_edges(*pair).collect()} == {"added"} and [r["status"] for r in api.changed_files(*pair).collect()] == ["added"]
    compared = api.compare_snapshots(*pair).first()
    assert [p.rpartition("/")[2] for p in compared["files_added"]] == ["view_page.py"] and compared["files_removed"] == compared["files_modified"] == [] and compared["architecture_before"] == text["macro"]
    assert api.compare_architecture(repo, head, "none").first()["error"].startswith("no snapshots") and api.compare_architecture(repo, head, head).first()["error"] is None
    assert api.compare_snapshots(*pair).first()["added"] == 1 and api.changed_patterns(*pair).columns == ["pattern", "change"]
    assert [r["file"].rpartition("/")[2] for r in api.riskiest_changes(repo, *pair).collect()] == ["view_page.py"] and api.analysis_links(repo).count() == 0
    assert api.delete_snapshot(later["snapshot_id"]) == 1
    assert api.import_git_history(repo, str(repository)) >= 3 and api.import_git_history(repo, str(repository)) == 0
    messages = [r["message"] for r in api.commits(repo).collect()]
    assert sorted(messages) == ["first | with a bar", "second"]
    log = git.log(spark, repository).orderBy("n").collect()
    status = {r["path"]: r["status"] for r in api.compare_commits(repo, log[1]["hash"], log[0]["hash"]).collect()}
    assert status["src/item_model.py"] == "modified"
    assert api.file_history(repo, "item_model.py").count() == 2 and api.contributors(repo).first()["author"] == "a@b"
    assert {r["status"] for r in api.check_integrity(repo, spark.createDataFrame([("src/item_model.py", "x"), ("new", "y")], "file_path string, hash string")).collect()} == {"tampered", "not_tracked"}
    assert api.delete_snapshot(snapshot[0]["snapshot_id"]) == 1 and api.delete_repository(repo) > 0 and not api.load(repo)
    assert api.status(api.analyze("", workspace=str(tmp_path)))["status"] == "failed"
    assert git.head(spark, repository).first()["message"] == "second" and not git.dirty(repository) and git.head(spark, tmp_path).count() == 0


def test_git_as_a_source(spark, repository):
    """Partitions are commits; each reads and hashes its own, and all together are what one gives."""
    for i in range(7):
        (repository / "src" / f"é {i}.py").write_text(f"x = {i}\n" * 1000)
        subprocess.run(["git", "-C", str(repository), "add", "."], check=True)
        subprocess.run(["git", "-c", "user.email=c@d", "-c", "user.name=C", "-C", str(repository), "commit", "-qm", f"more {i}"], check=True)
    (repository / "src" / "é 0.py").unlink()
    subprocess.run(["git", "-c", "user.email=c@d", "-c", "user.name=C", "-C", str(repository), "commit", "-qam", "less"], check=True)
    for kind in (git.GitLog, git.GitBlobs):
        spark.dataSource.register(kind)
    log = spark.read.format("git_log").option("commits", 3).load(str(repository))
    assert log.rdd.getNumPartitions() == 4 and [r["message"] for r in log.orderBy("n").collect()] == ["less", *[f"more {i}" for i in range(6, -1, -1)], "second", "first | with a bar"]
    blobs = spark.read.format("git_blobs").option("commits", 2).load(str(repository)).collect()
    assert sorted(map(str, blobs)) == sorted(map(str, spark.read.format("git_blobs").load(str(repository)).collect()))
    for name, many in (("src/é 3.py", 1), ("src/item_model.py", 2)):
        own = {r["hash"] for r in blobs if r["file_path"] == name}
        assert len(own) == many and hashlib.sha256((repository / name).read_bytes()).hexdigest() in own
    assert len([r for r in blobs if r["file_path"] == "src/é 0.py"]) == 1 and git.log(spark, repository, 2).count() == 2


def test_prompts_and_sections():
    assert reports.sections("# MACRO\nbig\n## Meso level\nmiddle\n**Micro**\nsmall") == {"macro": "big", "meso": "middle", "micro": "small"}
    assert reports.sections("all of it")["macro"] == "all of it"
    assert "none" in reports.impact_prompt("a", "modify", "low", [], []) and reports.pattern_lines([]) == "- none"


def test_streamed_versions(spark, tmp_path):
    from lodestone.sources.store import Store

    rows = spark.createDataFrame([("r", "a", f"h{i % 3}", f"c{i % 3}", i % 3, "u") for i in range(9)], "repo_id string, file_path string, hash string, commit_hash string, ts long, author string")
    rows.withColumn("ts", F.timestamp_seconds(F.col("ts") + 1_700_000_000)).repartition(3).write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        source = stream.unique(stream.read(spark, str(tmp_path / "in"), files=1))
        stream.track(source, store, str(tmp_path / f"check{os.urandom(2).hex()}")).awaitTermination()
    assert store.read("file_versions").count() == 3


def test_streamed_lineage_goes_on_after_a_restart(spark, tmp_path):
    from lodestone.operators import versions

    rows = [("r", f"f{i % 3}", f"h{i % 7 // 2}", f"c{i}", i * 60, "u") for i in range(40)]
    table = spark.createDataFrame(rows, "repo_id string, file_path string, hash string, commit_hash string, at long, author string")
    table = table.select("repo_id", "file_path", "hash", "commit_hash", F.timestamp_seconds(F.col("at") + 1_700_000_000).alias("ts"), "author", "at")
    parts = [table.filter(f"at div 600 = {k}").drop("at") for k in range(4)]
    got = lambda: spark.read.parquet(str(tmp_path / "out")).collect()
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream.follow(stream.read(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        assert len(got()) == 10 * (k + 1)
    want = {(r["file_path"], r["commit_hash"]): r["previous_hash"] for r in versions.file_history(table).collect()}
    assert {(r["file_path"], r["commit_hash"]): r["previous_hash"] for r in got()} == want
    assert all(r["change"] == ("first" if r["previous_hash"] is None else "same" if r["previous_hash"] == r["hash"] else "changed") for r in got())
    # One that comes late, but within the watermark, changes nothing after it.
    old = spark.createDataFrame([("r", "f0", "old", "late", 1_700_000_000 + 60 * 30 - 5, "u"), ("r", "f0", "new", "next", 1_700_000_000 + 60 * 60, "u")], "repo_id string, file_path string, hash string, commit_hash string, ts long, author string")
    old.withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream.follow(stream.read(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    last = {r["commit_hash"]: (r["previous_hash"], r["change"]) for r in got() if r["commit_hash"] in ("late", "next")}
    assert last == {"late": (None, "late"), "next": (rows[39][2], "changed")}
