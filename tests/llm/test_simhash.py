import random

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import components as components_module
from lodestone.llm import simhash
from lodestone.llm.components import components


def brute(texts, radius=2):
    prints = []
    for t in texts:
        raw = (t or "").encode()
        w = "".join(chr(b + 32) if 65 <= b <= 90 else chr(b) for b in raw).encode("latin-1")
        words, one = [], b""
        for b in w + b" ":
            if b == 0x20 or 9 <= b <= 13:
                if one:
                    words.append(one)
                one = b""
            else:
                one += bytes([b])
        grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints.append(sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h)))
    return prints


def classes(prints, radius):
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(len(prints)):
                if (prints[i] ^ prints[j]).bit_count() <= radius and label[j] < label[i]:
                    label[i] = label[j]
                    changed = True
    return label


@given(st.lists(st.integers(0, 2**64 - 1), max_size=40), st.integers(0, 10))
@settings(max_examples=60, deadline=None)
def test_tree_finds_all_within(values, radius):
    tree = simhash.Tree()
    for v in values:
        tree.add(v)
    x = values[0] ^ 5 if values else 0
    assert sorted(tree.within(x, radius)) == [i for i, v in enumerate(values) if (v ^ x).bit_count() <= radius]


def test_documents_against_brute_force(spark):
    texts = [None, "", " \t\n", "One", "one", "ONE two", "É é", "é é", "a b c d e f g h i j k l m n o p"] + ["w%d" % (i % 7) * 2 + " x" * (i % 5) for i in range(20)] + ["long text " * 3000 + "end", "long text " * 3000 + "End"]
    docs = spark.createDataFrame([(100 - i, t, "x") for i, t in enumerate(texts)] + [(None, "one", "y"), (97, "One", "z")], "doc_id long, text string, fp string")
    got = sorted(((r["id"] is not None, r["id"], r["fp"] % 2**64, r["component"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(None, "one"), (97, "One")]
    prints = brute([t for _, t in rows])
    label = classes(prints, 2)
    least = {}
    for (i, _), k in zip(rows, label):
        if i is not None:
            least[k] = min(i, least.get(k, i))
    want = sorted(((i is not None, i, p, least.get(k)) for (i, _), p, k in zip(rows, prints, label)), key=str)
    assert got == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_cut_shards_lose_no_link(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = list({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (1 << 64) - 1 for b in base for _ in range(60)})
    nodes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    label = classes(prints, 2)
    want = sorted(sorted(p for p, k in zip(prints, label) if k == c) for c in set(label))
    for shard in (7, 10_000):
        links = simhash.link_fingerprints(nodes, 2, shard)
        assert all(((r["a"] ^ r["b"]) % 2**64).bit_count() <= 2 for r in links.collect())
        root = {r["node"] % 2**64: r["root"] for r in components(links).collect()}
        groups = {}
        for p in prints:
            groups.setdefault(root.get(p, ("alone", p)), []).append(p)
        assert sorted(sorted(g) for g in groups.values()) == want


def test_hot_keys_are_spread(spark, monkeypatch):
    monkeypatch.setattr(components_module, "HOT", 5)
    edges = [(i, i + 1) for i in range(1, 12)] + [(100, 100 + i) for i in range(1, 60)] + [(300 + i, 400) for i in range(40)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 13)} | {100 + i: 100 for i in range(60)} | {300 + i: 300 for i in range(40)} | {400: 300}
    docs = spark.createDataFrame([(i, "one and the same text" if i % 3 else f"text {i} of its own words {i}") for i in range(60)], "doc_id long, text string")
    named = {r["id"]: r["component"] for r in simhash.near_duplicates(docs).collect()}
    assert len(named) == 60 and all(named[i] == (1 if i % 3 else named[i]) for i in named)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 70)] + [(1000, 1000 + i) for i in range(1, 90)] + [(5, 5), (7, None)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 71)} | {1000 + i: 1000 for i in range(90)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_only_links_of_the_similarity_delete_documents(spark):
    rng = random.Random(8)
    fresh = iter(range(10**9))
    new = lambda n: [f"u{next(fresh)}" for _ in range(n)]
    rows = []
    for i in range(150):
        base = new(204)
        own = list(base)
        # n words replaced far apart: 200 - 5n of 200 + 5n shingles are shared.
        for p in range(rng.choice([2, 4, 5, 6, 7, 8]) * (i > 0)):
            own[10 + 20 * p : 11 + 20 * p] = new(1)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(own))]
    line = " ".join(new(20)) + " "
    rows += [(1000 + k, line * 30 + " ".join(new(80))) for k in range(2)]
    grams = {i: set(zip(*(t.split()[k:] for k in range(5)))) for i, t in rows}
    near = lambda a, b: len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]) - 1e-9
    want = {2 * i + 1: near(2 * i, 2 * i + 1) for i in range(150)} | {1001: near(1000, 1001)}
    got = {r["id"]: r["component"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = {i: got[i] == i - 1 for i in want}
    assert not [i for i, x in linked.items() if x and not want[i]]
    assert sum(want.values()) > 40 and not want[1001] and sum(linked.values()) >= 0.97 * sum(want.values())
    assert all(got[i] in (i, i - 1) for i in got)
