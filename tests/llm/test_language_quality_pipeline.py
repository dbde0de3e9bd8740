import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import arrow, bpe, decontam, language, quality, simhash
from lodestone.llm.common import written
from lodestone.llm.queries import table

SF = "/root/testdata/sf0.001"
WORDS = {"en": "the and with from this house water morning people".split(), "fr": "le les avec dans cette maison été matin être".split(), "de": "der und mit aus dieses häuser wasser morgen straße".split()}


def documents(rng, n):
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(3, 40))), lang, f"http://{lang}{i % 3}.example.{lang}/x"))
    return rows


def test_held_out_accuracy_and_fusion(spark):
    rng = random.Random(1)
    train = documents(rng, 300)
    # Held out: no declared language. The last ones have only a host, or only a declared language, or nothing to go by.
    test = [(1000 + i, t, None, a) for i, (_, t, _, a) in enumerate(documents(random.Random(2), 100))]
    truth = {1000 + i: l for i, (_, _, l, _) in enumerate(documents(random.Random(2), 100))}
    odd = [(2000, None, None, "http://fr1.example.fr/"), (2001, "", "de", None), (2002, "123 !!", None, None), (2003, "x" * 3_000_000, "en", None), (2004, " ".join(WORDS["de"] * 9), "en", "http://fr1.example.fr"), (2004, " ".join(WORDS["de"] * 9), "en", "http://fr1.example.fr")]
    docs = spark.createDataFrame([(*r, 7) for r in train + test + odd], "doc_id long, text string, lang string, url string, host int").repartition(3)
    rows = language.identify(docs, declared_col="lang", address_col="url").collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(train + test + odd) and rows[0].__fields__[:5] == docs.columns
    assert np.mean([got[i]["language"] == l for i, l in truth.items()]) > 0.98
    assert got[2000]["language"] == "fr" and not got[2000]["accepted"]
    assert got[2001]["language"] == "de" and not got[2001]["accepted"] and not got[2002]["accepted"]
    assert got[2004]["language"] == "de" and got[2004]["accepted"]
    assert language.identify(docs.limit(0), address_col="url").count() == 0
    none = language.identify(docs.withColumn("lang", F.lit(None).cast("string")), address_col=None).first()
    assert none["language"] is None and not none["accepted"]


def test_rare_and_many_languages(spark):
    rng = random.Random(3)
    letters = [chr(c) for c in range(ord("a"), ord("z") + 1)]
    words = {f"l{k}": ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 8))) for _ in range(15)] for k in range(80)}
    text = lambda k: " ".join(rng.choice(words[f"l{k}"]) for _ in range(30))
    rows = [(1000 * k + i, text(k), f"l{k}") for k in range(80) for i in range(400 if k == 0 else 4)]
    test = [(10**6 + k, text(k), None) for k in range(80)]
    alien = [(2 * 10**6 + i, " ".join("".join(rng.choice("жзийклмнопрст") for _ in range(6)) for _ in range(30)), None) for i in range(5)]
    docs = spark.createDataFrame(rows + test + alien, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify(docs, address_col=None).collect()}
    assert len(got) == len(rows + test + alien)
    assert all(got[10**6 + k]["language"] == f"l{k}" and got[10**6 + k]["accepted"] for k in range(80))
    assert all(got[i]["language"] == "other" and not got[i]["accepted"] for i, _, _ in alien)


def test_quality_on_held_out_rows(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents").limit(3000)
    labels = table(spark, "/root/testdata/sf0.1", "labels")
    fit = labels.filter("doc_id % 3 > 0")
    held = {r["doc_id"]: r["quality"] for r in labels.filter("doc_id % 3 = 0").collect()}
    model = quality.fit(docs, fit)
    got = {r["doc_id"]: r for r in quality.score(docs, model).select("doc_id", "quality", "kept").collect() if r["doc_id"] in held}
    assert len(got) > 200 and np.mean([r["kept"] == held[i] for i, r in got.items()]) > 0.99


def test_quality_of_odd_rows(spark):
    rows = [(i, "Good words, in plain lines.\nAnd more of them." * (1 + i % 4) if i % 2 else "BAD!! " * (3 + i % 7), "s", "en", 1) for i in range(80)]
    rows += [(90, None, None, None, 1), (91, "", None, None, 1), (92, "word " * 400_000, "s", "en", 1), (None, "Good words.", "s", "en", 1), (1, rows[1][1], "s", "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, kept int")
    labels = spark.createDataFrame([(i, i % 2, 5) for i in range(80)] + [(1, None, 5), (1, 1, 5), (500, 1, 5)], "doc_id long, quality int, text int")
    got = quality.score(docs, quality.fit(docs, labels), out=("a", "b", "q", "k")).collect()
    assert len(got) == len(rows) and all(r["k"] == bool(r["doc_id"] % 2) for r in got if r["doc_id"] is not None and r["doc_id"] < 80)
    one = quality.score(docs, quality.fit(docs, labels.filter("quality = 1")), out=("a", "b", "q", "k"))
    assert one.filter("k").count() == len(rows)
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0


def jaccard(a, b):
    grams = lambda t: set(zip(*(t.lower().split()[i:] for i in range(5)))) or {tuple(t.lower().split())}
    a, b = grams(a or ""), grams(b or "")
    return len(a & b) / len(a | b) if a | b else 1.0


def test_similar_documents(spark):
    rng = random.Random(6)
    words = [f"v{i}" for i in range(900)]
    rows, origin = [], {}
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([80, 200, 500]))]
        rows.append((10 * i, " ".join(base)))
        for k in range(1, rng.randrange(4)):
            own = list(base)
            for _ in range(max(1, len(own) // 200)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((10 * i + k, " ".join(own) if k < 3 else " ".join(base).upper()))
            origin[10 * i + k] = 10 * i
    rows += [(900, None), (901, ""), (902, "one two"), (903, "One  two"), (904, "two one"), (0, rows[0][1]), (0, rows[0][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component int")
    found = {(r["id"], r["h"]): r["component"] for r in simhash.similar_documents(docs).collect()}
    by_id = {i: c for (i, _), c in found.items()}
    near = [(i, o) for i, o in origin.items() if jaccard(dict(rows)[i], dict(rows)[o]) >= 0.85]
    assert len(near) > 40 and np.mean([by_id[i] == o for i, o in near]) > 0.97
    assert all(by_id[10 * i] == 10 * i for i in range(60))
    assert by_id[901] == 900 and by_id[903] == 902 and by_id[904] == 904
    kept = sorted(r["doc_id"] for r in simhash.deduplicated(docs).collect())
    assert kept == sorted(set(by_id.values())) and simhash.deduplicated(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [5, 9, 40, 500, 9000])
def test_shard_keys_meet_the_recall(n):
    """Sets of just the least similarity share a key, by a number of keys that doesn't depend on how many sets there are; others hardly do."""
    count, rng = simhash.bands(0.8), np.random.default_rng(n)
    assert count == 8
    met = apart = 0
    for _ in range(400):
        # Of 9 m hashes 8 m and a little more are shared.
        h = np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64))
        own, other = (np.sort(np.delete(h, range(k, n // 10 + k))) for k in (0, n // 10))
        assert len(np.intersect1d(own, other)) >= 0.8 * len(np.union1d(own, other)) - 1e-9
        met += (simhash.shard_keys(own, count) == simhash.shard_keys(other, count)).any()
        apart += (simhash.shard_keys(own, count) == simhash.shard_keys(own + np.uint64(1), count)).any()
    assert met >= 0.985 * 400 and apart <= 2


def test_clashing_columns_nulls_and_long_texts_in_every_stage(spark):
    own = ["language", "__row", "__id", "__h", "__a", "__kept", "__accepted", "__text", "n", "id", "component", "h"]
    docs = table(spark, SF, "documents").limit(60)
    for i, c in enumerate(own):
        docs = docs.withColumn(c, F.lit(i))
    long = "Some plain words, one after another, that run on. " * 40_000
    extra = [(None, None, None, None, None), (10**6, "", "en", "s", 0), (10**6 + 1, long, "en", "s", len(long)), (10**6 + 1, long, "en", "s", len(long)), (None, "  \n", None, None, 3)]
    more = spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(more, allowMissingColumns=True).repartition(3)
    rows = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF).collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert got and all(r in rows for r in got), name
            assert stage(spark, docs.limit(0), SF).count() == 0
        else:
            assert len(got) == len(rows)
    kept = simhash.deduplicated(docs).collect()
    assert sum(r["doc_id"] == 10**6 + 1 for r in kept) == 1 and sum(r["doc_id"] is None for r in kept) == 1
    named = language.identify(docs)
    assert named.columns == [c for c in docs.columns if c != "language"] + ["language", "confidence", "accepted"] and named.count() == len(rows)


def test_language_stage_against_brute_force(spark):
    """The posterior by plain loops over the same likelihoods."""
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang", "source")
    rows = docs.collect()
    declared = sorted({r["lang"].lower() for r in rows if r["lang"]})
    counts = {x: sum((r["lang"] or "").lower() == x for r in rows) for x in declared}
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.coalesce("text", F.lit("")).alias("text"), F.lower("lang").alias("declared"))
    model, size = language.fit(keyed, counts), len(declared) + 1
    soft, logs = [], []
    for r in rows:
        log, n = language.likelihoods([r["text"] or ""], model)
        log = [x + (0 if not r["lang"] else math.log(1 - language.WRONG) if k < size - 1 and declared[k] == r["lang"].lower() else math.log(language.WRONG / (size - 1))) for k, x in enumerate(log[0])]
        e = [math.exp(x - max(log)) for x in log]
        soft.append([x / sum(e) for x in e])
        logs.append((log, int(n[0])))
    total = [sum(p[k] for p in soft) + 1 for k in range(size)]
    by_source = {}
    for r, p in zip(rows, soft):
        by_source.setdefault(r["source"], []).append(p)
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    for r, p, (log, n) in zip(rows, soft, logs):
        host = [sum(q[k] for q in by_source[r["source"]]) - p[k] for k in range(size)]
        # Sources here have no dot, so their suffix is that of all.
        suffix = [t - 1 - x for t, x in zip(total, p)]
        back = [(s + language.SMOOTH * t / sum(total)) / (sum(suffix) + language.SMOOTH) for s, t in zip(suffix, total)]
        prior = [(h + language.SMOOTH * s) / (sum(host) + language.SMOOTH) for h, s in zip(host, back)]
        post = [math.exp(x - max(log)) * max(h, 1e-12) for x, h in zip(log, prior)]
        best = max(range(size), key=lambda k: post[k])
        if n and max(log[:-1]) - log[-1] < math.log(size / language.CHANCE):
            best = size - 1
        own = got[r["doc_id"]]
        assert own["language"] == [*declared, "other"][best]
        assert abs(own["confidence"] - post[best] / sum(post)) < 1e-4 and own["accepted"] == (best < size - 1 and n > 0 and post[best] / sum(post) >= language.ACCEPT)


def test_quality_against_plain_gradient_steps():
    """The views' and the joint regression's optimum, found by small steps."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(size=200) > 0).astype(int)
    model = quality.Logistic(x, y)
    z = np.c_[np.clip((x - x.mean(axis=0)) / x.std(axis=0), -8, 8), np.ones(200)]
    w = np.zeros(4)
    for _ in range(20_000):
        w -= 0.01 * (z.T @ (1 / (1 + np.exp(-z @ w)) - y) + np.array([0.3, 0.3, 0.3, 1e-6]) * w)
    assert np.abs(w - model.w).max() < 1e-3


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    kept, rows = docs, {r["doc_id"]: r for r in docs.collect()}
    counts = [len(rows)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
        own = kept.collect()
        assert all(rows[r["doc_id"]] == r for r in own), name
        counts.append(len(own))
    assert counts[1] < counts[0] and counts[3] < counts[2] and counts[4] < counts[3]
    bad = {r["doc_id"] for r in table(spark, SF, "labels").filter("quality = 0").collect()}
    assert len(bad & {r["doc_id"] for r in own}) <= 1
    last = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r["doc_id"] for r in last) == sorted(r["doc_id"] for r in own) and len(last) == counts[4]
    items = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    assert not [r["doc_id"] for r in own if any(t in r["text"] for t in items)]


def test_later_stages_against_brute_force(spark):
    """Near copies by all pairs, leaks by the edit distance of all pairs, ids by the library; on what the first two stages keep."""
    stages = dict(corpus_pipeline.STAGES)
    docs = written(stages["language ID"](spark, stages["quality classifier"](spark, table(spark, SF, "documents"), SF), SF), "in")
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    grams = [set(zip(*(r["text"].encode().lower().split()[i:] for i in range(5)))) or {tuple(r["text"].encode().lower().split())} for r in rows]
    label = list(range(len(rows)))
    for _ in range(8):
        for i in range(len(rows)):
            for j in range(i):
                if label[i] != label[j] and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                    label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    deduped = written(stages["SimHash near-dedup"](spark, docs, SF), "deduped")
    assert sorted(r["doc_id"] for r in deduped.collect()) == [rows[i]["doc_id"] for i in sorted(set(label))]

    items = [decontam.word_hashes([r["text"]])[0].view(np.int64) for r in table(spark, SF, "benchmark").collect()]
    want = []
    for r in deduped.collect():
        words = decontam.word_hashes([r["text"]])[0].view(np.int64)
        limit = lambda x: len(x) // 5 if len(x) >= 5 else 0
        if not any(len(x) and decontam.edits(x, words)[0] <= limit(x) for x in items):
            want.append(r["doc_id"])
    clean = written(stages["benchmark decontamination"](spark, deduped, SF), "clean")
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(want) and len(want) < deduped.count()

    model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = {r["doc_id"]: tuple(r) for r in stages["byte-level BPE encoding and decoding"](spark, clean, SF).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in clean.collect():
        ids = model.encode_ordinary(r["text"])
        assert got[r["doc_id"]] == (r["doc_id"], len(ids), sha(np.array(ids, "<u4").tobytes()), sha(r["text"].encode()))


def test_texts_go_to_python_once_and_in_bounded_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('wörd and ', 500) AS text", "'s' AS source", "'en' AS lang").repartition(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    found = arrow.mapped(docs, sizes, "n long, bytes long").collect()
    assert sum(r["n"] for r in found) == 3000 and max(r["bytes"] for r in found) <= arrow.BATCH_BYTES + 10_000
    spark.conf.set(key, "1m")
    assert max(r["bytes"] for r in arrow.mapped(docs, sizes, "n long, bytes long").collect()) <= (1 << 20) + 10_000
    spark.conf.unset(key)
    for out in (quality.score(docs, quality.CoTrained(*[np.zeros((0, 2))] * 2, np.zeros(0), np.zeros(0), *[np.zeros((0, 2))] * 2)), language.identify(docs)):
        assert int(spark.conf.get(key)) == arrow.BATCH_BYTES
        plan = out._jdf.queryExecution().optimizedPlan()
        while plan.nodeName() != "MapInArrow":
            plan = plan.children().apply(0)
        assert "__text" not in plan.children().apply(0).output().mkString(",")
    # Texts of another type, and null ones, as before.
    odd = spark.createDataFrame([(1, None, "s", "en"), (2, 77, "s", "en")], "doc_id long, text int, source string, lang string")
    as_text = odd.withColumn("text", F.col("text").cast("string"))
    for f in (language.identify, lambda d: quality.score(d, quality.fit(d, spark.createDataFrame([(1, 1)], "doc_id long, quality int")))):
        assert [r[4:] for r in sorted(f(odd).collect())] == [r[4:] for r in sorted(f(as_text).collect())]
