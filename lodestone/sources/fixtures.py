"""Engine tables derived from the driver's relational tables, by rules that SQL can say as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the derivation.
DIRECTORIES = ["controllers", "services", "models", "views", "adapters", "domain", "util"]
STEMS = ["user_controller", "order_service", "item_model", "page_view", "db_adapter", "event_listener", "message_publisher", "helper", "repo_interface"]
EXTENSIONS = [".py", ".py", ".js", ".java", ".py"]
EXTERNAL = ["os", "react", "numpy", "lodash", "json"]
FUNCTIONS = 1500

#: Calls that a task gets, as expected.
ROWS = 250_000


def _pick(values: list[str], i) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))


def modular_edges(nodes: DataFrame, n: DataFrame) -> DataFrame:
    """(rule, s, d): edges between numbers below n by three rules, without loops, each pair once."""
    s = F.col("s")
    rules = F.array(
        F.when(s % 4 != 0, F.struct(F.lit(0).alias("rule"), ((3 * s + 1) % F.col("n")).alias("d"))),
        F.when(s % 3 == 0, F.struct(F.lit(1).alias("rule"), ((7 * s + 5) % F.col("n")).alias("d"))),
        F.when(s % 5 == 2, F.struct(F.lit(2).alias("rule"), (s % 10).alias("d"))),
    )
    found = nodes.crossJoin(F.broadcast(n)).select("s", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("e")).select("s", "e.d", "e.rule").filter("s <> d")
    return found.groupBy("s", "d").agg(F.min("rule").alias("rule"))


class Fixtures:
    """The engine's tables for one folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    def _ids(self) -> DataFrame:
        d = F.col("doc_id")
        directory, stem, ext = _pick(DIRECTORIES, d), _pick(STEMS, d), _pick(EXTENSIONS, d)
        return self.raw("documents").select(
            d.alias("file_id"),
            F.concat(F.lit("/repo/"), "source", F.lit("/"), directory, F.lit("/"), stem, F.lit("_"), d.cast("string"), ext).alias("path"),
            F.concat(stem, F.lit("_"), d.cast("string")).alias("stem"),
            directory.alias("dir"),
            ext.alias("ext"),
        )

    def paths(self) -> DataFrame:
        """(file_id, path)"""
        return self._ids().select("file_id", "path")

    def files(self) -> DataFrame:
        """(repo_id, file_id, path, language, content_hash)"""
        from ..functions import paths

        rows = self._ids().join(self.raw("documents").select(F.col("doc_id").alias("file_id"), F.sha2("text", 256).alias("content_hash")), "file_id")
        return rows.select(F.lit("main").alias("repo_id"), "file_id", "path", paths.language(F.col("ext")).alias("language"), "content_hash")

    def id_edges(self) -> DataFrame:
        docs = self.raw("documents")
        return modular_edges(docs.select(F.col("doc_id").alias("s")), docs.agg(F.count("*").alias("n")))

    def edges(self) -> DataFrame:
        """(src, dst): the dependencies, as paths."""
        p = self.paths()
        return self.id_edges().join(p.select(F.col("file_id").alias("s"), F.col("path").alias("src")), "s").join(p.select(F.col("file_id").alias("d"), F.col("path").alias("dst")), "d").select("src", "dst")

    def block_edges(self) -> DataFrame:
        """(src, dst): edges between numbers of files, within blocks of eight."""
        s = F.col("s")
        rows = self.raw("documents").select(F.col("doc_id").alias("s"))
        rows = rows.select("s", F.explode(F.array(*[s - s % 8 + (k * s + k // 2) % 8 for k in (3, 5, 7)])).alias("d"))
        return rows.filter("s <> d").distinct().select(F.col("s").alias("src"), F.col("d").alias("dst"))

    def imports(self) -> DataFrame:
        """(file, pos, module): raw import strings, some of them external."""
        f = self._ids()
        own = self.id_edges().join(f.select(F.col("file_id").alias("s"), F.col("path").alias("file")), "s").join(f.select(F.col("file_id").alias("d"), "stem", "dir"), "d")
        kind = (F.col("s") + F.col("rule")) % 4
        module = F.when(kind == 0, F.col("stem")).when(kind == 1, F.concat(F.lit("./"), "stem")).when(kind == 2, F.concat_ws("/", "dir", "stem")).otherwise(F.concat_ws(".", "dir", "stem"))
        return own.select("file", F.col("rule").cast("int").alias("pos"), module.alias("module")).unionByName(f.select(F.col("path").alias("file"), F.lit(9).alias("pos"), _pick(EXTERNAL, F.col("file_id")).alias("module")))

    def _file_of(self, number) -> DataFrame:
        """The paths with their count, to be joined on number % n."""
        return self.paths().crossJoin(F.broadcast(self.raw("documents").agg(F.count("*").alias("n"))))

    def functions(self) -> DataFrame:
        """(name, file, line); of one name in one file the last line stays."""
        n = F.broadcast(self.raw("documents").agg(F.count("*").alias("n")))
        rows = self.raw("part").crossJoin(n).select(F.concat(F.lit("fn_"), (F.col("p_partkey") % FUNCTIONS).cast("string")).alias("name"), (F.col("p_partkey") % F.col("n")).alias("file_id"), "p_size", "p_partkey")
        return rows.join(self.paths(), "file_id").groupBy("name", F.col("path").alias("file")).agg(F.max_by("p_size", "p_partkey").alias("line"))

    def file_calls(self) -> DataFrame:
        """(file, callee): calls in files, each once. Tasks are as many as rows ask for: by their bytes, as these compress well, each would get millions."""
        n, raw = F.broadcast(self.raw("documents").agg(F.count("*").alias("n"))), self.raw("lineitem")
        parts = max(1, -(-raw.count() // ROWS))
        most = max(parts, int(self.spark.conf.get("spark.sql.shuffle.partitions")))  # with fewer, a join would deal them out anew
        rows = raw.crossJoin(n).select((F.col("l_suppkey") * 7 % F.col("n")).alias("file_id"), (F.col("l_partkey") % FUNCTIONS).alias("f")).repartition(parts, "file_id").distinct()
        return rows.join(self.paths().repartition(parts, "file_id"), "file_id").select(F.col("path").alias("file"), F.concat(F.lit("fn_"), F.col("f").cast("string")).alias("callee")).repartition(most, "file", "callee").distinct()

    def part_edges(self) -> DataFrame:
        """(rule, s, d): edges between the numbers of parts."""
        part = self.raw("part")
        return modular_edges(part.select(F.col("p_partkey").alias("s")), part.agg(F.count("*").alias("n")))

    def function_calls(self) -> DataFrame:
        """(file, caller, callee): calls between functions, from the caller's file, by the callee's name."""
        n = F.broadcast(self.raw("documents").agg(F.count("*").alias("n")))
        name = lambda c: F.concat(F.lit("fn_"), (F.col(c) % FUNCTIONS).cast("string"))
        rows = self.part_edges().crossJoin(n).select((F.col("s") % F.col("n")).alias("file_id"), name("s").alias("caller"), name("d").alias("callee")).distinct()
        return rows.join(self.paths(), "file_id").select(F.col("path").alias("file"), "caller", "callee")

    def versions(self) -> DataFrame:
        """(repo_id, file_path, hash, commit_hash, ts, author)"""
        return self.raw("events").select(
            F.lit("main").alias("repo_id"),
            F.concat("event_type", F.lit("/"), (F.col("user_id") % 20).cast("string")).alias("file_path"),
            F.sha2("props", 256).alias("hash"),
            F.date_format("ts", "yyyy-MM-dd").alias("commit_hash"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("author"),
        )

    def commits(self) -> DataFrame:
        """(repo_id, commit_hash, ts, author, message): one of each day."""
        first = self.versions().groupBy("repo_id", "commit_hash").agg(F.min("ts").alias("ts"), F.min_by("author", F.struct("ts", "author")).alias("author"))
        return first.withColumn("message", F.concat(F.lit("commit "), "commit_hash"))

    def snapshots(self) -> DataFrame:
        """(snapshot_id, repo_id, commit_hash, total_files, total_deps, avg_coupling, cycle_count): after the 10th, 20th and 30th."""
        cuts = self.spark.createDataFrame([("s1", "2024-01-10", 1), ("s2", "2024-01-20", 2), ("s3", "2024-01-30", 3)], "snapshot_id string, commit_hash string, k long")
        counted = self.snapshot_files().groupBy("snapshot_id").agg(F.count("*").alias("total_files"))
        rows = cuts.join(counted, "snapshot_id")
        return rows.select("snapshot_id", F.lit("main").alias("repo_id"), "commit_hash", "total_files", (F.col("total_files") * F.col("k") * 2).alias("total_deps"), (F.col("k") * 1.25).cast("double").alias("avg_coupling"), (F.col("k") % 3).alias("cycle_count"))

    def snapshot_patterns(self) -> DataFrame:
        """(snapshot_id, pattern, detected, confidence): each a pattern more, surer by 0.2."""
        rows = [(f"s{k}", p, i < k, 0.3 + 0.2 * k if i < k else 0.0) for k in (1, 2, 3) for i, p in enumerate(("mvc", "layered", "event_driven"))]
        return self.spark.createDataFrame(rows, "snapshot_id string, pattern string, detected boolean, confidence double").withColumn("confidence", F.round("confidence", 2))

    def snapshot_coupling(self) -> DataFrame:
        """(snapshot_id, file): the files of a snapshot whose hash begins with one of k digits are highly coupled."""
        rows = self.snapshot_files()
        k = F.substring("snapshot_id", 2, 1).cast("int")
        return rows.filter(F.instr(F.substring(F.lit("0123456789"), F.lit(1), k), F.substring("hash", 1, 1)) > 0).select("snapshot_id", F.col("path").alias("file"))

    def snapshot_files(self) -> DataFrame:
        """(snapshot_id, path, hash): each file's last version before the cut, below a place that differs by snapshot."""
        cuts = self.spark.createDataFrame([("s1", "2024-01-10", "/tmp/r/src/"), ("s2", "2024-01-20", "C:\\Users\\u\\r\\src\\"), ("s3", "2024-01-30", "/tmp/q/src/")], "snapshot_id string, cut string, place string")
        rows = self.versions().join(F.broadcast(cuts), F.col("commit_hash") <= F.col("cut"))
        last = rows.groupBy("snapshot_id", "place", "file_path").agg(F.max_by("hash", F.struct("ts", "hash")).alias("hash"))
        own = F.when(F.col("snapshot_id") == "s2", F.replace("file_path", F.lit("/"), F.lit("\\"))).otherwise(F.col("file_path"))
        return last.select("snapshot_id", F.concat("place", own).alias("path"), "hash")

    def repositories(self) -> DataFrame:
        """(repo_id, name, url, current_commit)"""
        url = F.concat(F.lit("https://example.org/"), F.lower("n_name"), F.lit(".git"))
        return self.raw("nation").select(F.substring(F.sha2(url, 256), 1, 16).alias("repo_id"), F.col("n_name").alias("name"), url.alias("url"), F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("current_commit"), "n_nationkey")

    def chunks(self) -> DataFrame:
        """(id, embedding, label)"""
        return self.raw("embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
