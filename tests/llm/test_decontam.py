import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import decontam


def distance(item, words):
    """Least edit distance of the item to any run of words, plainly."""
    best = len(item)
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(words):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return min(best, *row)


@given(st.lists(st.integers(1, 4), max_size=8), st.lists(st.integers(1, 4), max_size=12))
@settings(max_examples=200, deadline=None)
def test_edits(item, words):
    assert decontam.edits(np.array(item, dtype=np.int64), np.array(words, dtype=np.int64))[0] == distance(item, words)


def test_words():
    h, owner = decontam.word_hashes(["The—café, THE “end”.", "", "a\0b x_1", "the end…"])
    assert owner.tolist() == [0, 0, 0, 0, 2, 2, 2, 2, 3, 3]
    assert h[0] == h[2] == h[8] and h[3] == h[9] and len(set(h.tolist())) == 7
    text = "ab cd " * 1000
    assert "".join(decontam.cut(text, 100)) == text
    whole, _ = decontam.word_hashes([text])
    assert (np.concatenate([decontam.word_hashes([p])[0] for p in decontam.cut(text, 100)]) == whole).all()


def planted(rng, words, items):
    """(document, items that it leaks): edited items among random words."""
    out, truth = [rng.choice(words) for _ in range(rng.randrange(80))], []
    for _ in range(rng.randrange(3)):
        i = rng.randrange(len(items))
        own = items[i][1].split()
        for _ in range(rng.randrange(int(0.35 * len(own)) + 1)):
            p = rng.randrange(len(own) or 1)
            rng.choice([lambda: own.__setitem__(p, "zz"), lambda: own.pop(p), lambda: own.insert(p, "yy")])() if own else None
        out += own + [rng.choice(words) for _ in range(rng.randrange(40))]
    return " ".join(out), truth


def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 5, 9, 14, 20, 36, 59])))) for i in range(40)] + [(40, ""), (41, None), (42, "... !"), (3, "w1 w2 w3 w4 w5 w6 w7")]
    docs = [(i, planted(rng, words, items[:40])[0]) for i in range(150)]
    docs += [(500, None), (501, ""), (502, items[39][1]), (502, items[39][1]), (None, items[38][1]), (503, items[30][1].upper().replace(" ", ",\n"))]
    table = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    got = sorted(((r["doc_id"], r["item_id"], r["edits"]) for r in decontam.find_leaks(table, spark.createDataFrame(items, "item_id long, text string"), items=25).collect()), key=str)
    want = []
    for d, text in docs:
        own = decontam._BREAK.sub(" ", (text or "").lower().replace(",", " ")).split()
        for i, item in items:
            w = [x for x in (item or "").split() if x[0] == "w"]
            k = int(0.2 * len(w) + 1e-9) if len(w) >= 5 else 0
            if w and distance(w, own) <= k:
                want.append((d, i, distance(w, own)))
    want = sorted(want, key=str)
    missed = [x for x in want if x[:2] not in {y[:2] for y in got}]
    assert len(want) > 100 and not [x for x in got if x[:2] not in {y[:2] for y in want}]
    assert len(missed) <= 0.01 * len(want)
    assert sum(x in want for x in got) >= 0.98 * len(want)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_leaks(table, empty).count() == 0 and decontam.find_leaks(table.limit(0), empty).count() == 0


def test_long_items_at_the_limit():
    rng = random.Random(9)
    items = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(n))) for i, n in enumerate([37, 59, 100, 150, 200, 300, 400] * 12)]
    found = decontam.Items(items)
    texts = []
    for i, item in items:
        own = item.split()
        n = len(own)
        for k, p in enumerate(sorted(rng.sample(range(n), n // 5), reverse=True)):
            own[p : p + 1] = [["zz"], [], ["zz", own[p]]][k % 3 if i >= 42 else 0]
        texts.append(" ".join([f"x{rng.randrange(99)}" for _ in range(rng.randrange(60))] + own + ["y"] * rng.randrange(60)))
    # One edit more than allowed, nowhere else.
    texts.append(" ".join("zz" if p % 100 in range(0, 100, 5) or p == 1 else w for p, w in enumerate(items[4][1].split())))
    got = {}
    for h, owner in decontam.document_words(texts):
        low = owner[0]
        got |= {(t + low, i): d for (t, i), (d, _) in found.leaks(h, owner - low).items()}
    want = {(i, i): distance(item.split(), texts[i].split()) for i, item in items}
    assert all(d <= len(items[i][1].split()) // 5 for (i, _), d in want.items())
    assert got == want


def test_common_openings_in_pieces(monkeypatch):
    """Many items with one opening, in a long text that repeats it: the meetings are looked at in pieces, with the same result."""
    opening = "one two three four five six seven eight "
    items = [(i, opening + " ".join(f"v{i}x{k}" for k in range(6))) for i in range(60)]
    found = decontam.Items(items)
    text = (opening * 40 + items[7][1] + " ") * 3
    h, owner = next(decontam.document_words([text]))
    whole = found.leaks(h, owner)
    pieces = [len(x) for x in found.anchors(found.places(np.where(np.isin(h, found.vocabulary), np.searchsorted(found.vocabulary, h) + 1, 0), owner), owner, 0, len(items))]
    monkeypatch.setattr(decontam, "HITS", 1000)
    assert found.leaks(h, owner) == whole and (0, 7) in whole and len(pieces) == 1


def test_blocks_are_bounded_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(decontam, "WORDS", 30)
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(12))) for i in range(9)] + [(9, "z " * 100)], "item_id long, text string")
    assert [len(b) for b in decontam.blocks(items, "item_id", "text", 100)] == [2, 2, 2, 2, 1, 1]
    docs = spark.createDataFrame([(i, "a b " + " ".join(f"w{i}x{k}" for k in range(12))) for i in range(11)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in decontam.find_leaks(docs, items).collect()) == list(range(9))
    assert sorted(r["doc_id"] for r in decontam.decontaminated(docs, items).collect()) == [9, 10]


def test_given_items_all_have_keys():
    import pyarrow.parquet as pq

    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        rows = pq.read_table(f"/root/testdata/{sf}/benchmark.parquet").to_pylist()
        found = decontam.Items([(r["item_id"], r["text"]) for r in rows])
        assert rows and not any(found.direct) and {i for t in found.table.values() for own in t.values() for i in own} == set(range(len(rows)))


def test_recall_of_keys_alone():
    """Windows at a leak's own diagonal share a key with their item, at every length and the most edits."""
    rng = np.random.default_rng(3)
    for n in (5, 8, 16, 30, 45, 59, 100, 200, 400):
        k, hits = int(0.2 * n + 1e-9), 0
        count = decontam.needed(decontam.grid(n), -(-decontam.grid(n) // 5))
        items = rng.integers(1, 1 << 40, (150, n))
        rows = []
        for own in items.tolist():
            for p in sorted(rng.choice(n, k, replace=False).tolist(), reverse=True):
                kind = int(rng.integers(3))
                own[p : p + (kind < 2)] = [int(rng.integers(1 << 41, 1 << 42))] * (kind != 1)
            rows.append([*own, *rng.integers(1 << 41, 1 << 42, n).tolist()][:n])
        a, b = decontam.keys(items, count), decontam.keys(np.array(rows), count)
        hits = int((a == b).any(axis=1).sum())
        assert hits >= 148, (n, hits)


def test_grid():
    assert [decontam.grid(n) for n in (1, 2, 3, 4, 5, 6, 7, 9, 13, 17, 25, 33, 49, 64, 65, 97, 512)] == [1, 2, 3, 4, 6, 6, 8, 12, 16, 24, 32, 48, 64, 64, 96, 128, 512]


def test_items_beyond_keys_are_compared_exactly(monkeypatch):
    monkeypatch.setattr(decontam, "LONGEST", 10)
    items = [(0, " ".join(f"w{i}" for i in range(40))), (1, " ".join(f"v{i}" for i in range(8)))]
    found = decontam.Items(items)
    assert found.direct == [True, False]
    h, owner = next(decontam.document_words([" ".join(f"w{i}" if i % 6 else "x" for i in range(40)) + " " + items[1][1]]))
    assert set(found.leaks(h, owner)) == {(0, 0), (0, 1)}
