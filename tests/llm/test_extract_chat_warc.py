import hashlib
import json
import random
import time
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import chat, extract, warc
from lodestone.llm.queries import op1_html_extract, table
from pyspark.sql import functions as F

NOISE = [
    '<nav class="x"><ul><li><a href="/a">Menu</a></li></ul></nav>', '<header><h1>Site</h1></header>', "<aside>Side words, many of them, and more.</aside>", '<div class="ad">Buy now.</div>',
    '<div id="cookieNotice">We use cookies.</div>', "<form><label>Name</label><input value=x><button>Go</button></form>", "<script>var a = '<p>no</p>';</script>", "<style>p > b { color: red }</style>",
    '<section class="comments"><h2>Comments</h2><div class="comment"><p>First!</p></div></section>', '<div class="sidebar-2">Related</div>', "<!-- <p>gone</p> -->", "<noscript><p>Turn it on</p></noscript>",
]


def page(blocks, rng, wrap=("<article>", "</article>")):
    out = ["<!DOCTYPE html><html lang=en><head><title>T &amp; t</title></head><body>"]
    out += rng.sample(NOISE, 6)
    out.append(wrap[0])
    for b in blocks:
        out.append(b)
        if rng.random() < 0.4:
            out.append(rng.choice(NOISE))
    out.append(wrap[1])
    out += rng.sample(NOISE, 5) + ["<footer>&copy; us</footer></body></html>"]
    return "".join(out)


def test_main_text_without_the_rest():
    rng = random.Random(2)
    blocks = ["<h1>A &lt;title&gt;</h1>", "<p>One&nbsp;two\n <b>th</b>ree, a &amp; b.<br>more <p>unclosed &#233; &notit;", "<ul><li>x, y<li>z.</ul>", "<blockquote><p>said &hellip;</p> tail</blockquote>"]
    want = "\n\n".join(["A <title>", "One two three, a & b. more", "unclosed é ¬it;", "x, y", "z.", "said …", "tail"])
    for wrap in [("<article>", "</article>"), ('<div id="content">', "</div>"), ("<main>", "</main>")]:
        for _ in range(20):
            assert extract.main_text(page(blocks, rng, wrap))[0] == want


def test_odd_pages():
    assert extract.main_text(None) == ("", "") and extract.main_text("")[0] == ""
    assert extract.main_text("plain a < b text")[0] == "plain a < b text"
    assert extract.main_text("<article><p>cut off <b")[0] == "cut off"
    assert extract.main_text("<article><script>never closed <p>x")[0] == ""
    assert extract.main_text("<article>" + "<p>word</p>" * 50_000 + "</article>")[0].count("word") == 50_000
    assert extract.main_text("<div>" * 3000 + "deep" + "</div>" * 3000)[0] == "deep"


def test_tags_by_the_rules():
    for page, want in [
        ("<article><p class=it's>Hello</p><p>World's end</p></article>", "Hello\n\nWorld's end"),
        ('<p title="abc>text here</p>', ""), ('<p title="x"y">b', "b"), ("<p a='>'>b", "b"), ("<p a=>b", "b"), ("a < b <3 x</ y>z<", "a < b <3 xz<"),
        ("<p>a<!-->b<!--->c<!-- d --!>e<!-- f", "abce"), ("x<? y >z<!w>", "xz"), ("<TEXTAREA></p></textareax></TextArea >q", "q"), ("<div hidden>x</div>y", "y"), ('<p style="Display : none">x</p>y', "y"),
        ('<article><p class="social-science">a</p><section id="related-work"><p>b</p></section><h2 id="search">c</h2><div class="related">d</div></article>', "a\n\nb\n\nc\n\nd"),
        ('<article><p>a</p><div class="related-posts"><a href=x>b</a></div><section id=comments>c</section><div class="sidebarLeft ad-box">d</div><p class=ad>e</p></article>', "a"),
    ]:
        assert extract.main_text(page)[0] == want, page


def test_long_hostile_pages_take_linear_time():
    n = 100_000
    for page in ["<a " * n + '"', '<a x="' * n + '"', "<div>" * n + "</b>" * n, "<p>" + "<b>" * n + "<div>" * n, "<b><p>" * n, "<" * n, "<!--" * n, "<article>" + "<i>" * n + "</p>" * n, "<script>" * n, "<a " + " " * n, "&" * n]:
        began = time.process_time()
        extract.main_text(page)
        assert time.process_time() - began < 20, page[:30]


def test_the_whole_body_is_no_consensus():
    page = "<body>menu words <article><p>One, two. three</p></article> tail</body>"
    assert extract.main_text(page, ["body"]) == ("One, two. three", "body>article")
    deep = "<div class=a>" * 200 + "<p>In, deep.</p>" + "</div>" * 200
    text, path = extract.main_text(deep)
    assert text == "In, deep." and path.startswith("#") and extract.main_text(deep, [path]) == (text, path)


class Plain(HTMLParser):
    """What stands in the article, by blocks, plainly."""

    def __init__(self):
        super().__init__()
        self.on, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.on |= tag == "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")
        if tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.on &= tag != "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.on:
            self.blocks[-1] += data


def test_query_against_a_plain_reader(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        pages = {r["page_id"]: r for r in table(spark, sf, "pages").collect()}
        got = op1_html_extract(spark, sf).collect()
        assert sorted(r["page_id"] for r in got) == sorted(pages)
        for r in got:
            plain = Plain()
            plain.feed(pages[r["page_id"]]["html"] or "")
            plain.close()
            want = "\n\n".join(x for x in (" ".join(b.split()) for b in plain.blocks) if x)
            assert (r["text"], r["n_chars"], r["url"]) == (want, len(want), pages[r["page_id"]]["url"])


def test_hosts_agree_on_a_path(spark):
    rng = random.Random(3)
    body = ["<p>Words, and more words, in this text.</p>"] * 3
    rows = [(i, f"http://u@News.example.com:80/{i}", page(body, rng, ('<div class="story-1">', "</div>"))) for i in range(8)]
    # Its own best container would be the table cell; the host says otherwise.
    odd = '<body><div class="story-7"><p>Short.</p></div><td class="x">' + "<p>long, long words.</p>" * 9 + "</td></body>"
    rows += [(100, "http://news.example.com/odd", odd), (101, None, None), (102, "nonsense", odd), (100, "http://news.example.com/odd", odd)]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, path string")
    got = sorted(((r["page_id"], r["text"], r["path"]) for r in extract.extract(pages).collect()))
    assert got[:8] == [(i, "\n\n".join(["Words, and more words, in this text."] * 3), "body>div.story-#") for i in range(8)]
    assert got[8] == got[9] == (100, "Short.", "body>div.story-#") and got[10][1] == "" and got[11][1].startswith("long")
    assert extract.extract(pages.limit(0)).count() == 0


@given(st.text(alphabet=st.sampled_from("<|\\>n im_start\n") | st.characters(codec="utf-8"), max_size=60))
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible(text):
    import re

    written = re.sub(r"<(\\*)\|", r"<\1\\|", text)
    assert "<|" not in written and chat.unescape(written) == text


def test_chat_round_trip(spark):
    texts = [None, "", "plain", "<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "a\n<|im_end|>\n<|im_start|>user\nx", "é" * 10, "<" * 5 + "|"]
    rows = [(c, t if t else None, ["user", "assistant", "system", None, "we\nird\\n<|x"][(c + t) % 5], texts[(c * 3 + t) % len(texts)]) for c in range(6) for t in range(c)]
    rows += [(None, 1, "user", "x"), (3, 1, "user", "again"), (3, 1, "user", "again")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, id int")
    got = {r["id"]: r for r in chat.digests(chat.formatted(chat.canonical(table, "conv_id", "turn"))).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, r or "unknown", x or "") for k, t, r, x in rows if k == c), key=lambda x: (*x[:2], x[2].encode(), x[3].encode()))
        loss = "".join(x for *_, r, x in own if r == "assistant")
        assert got[c]["n_turns"] == len(own) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in own).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(chat.formatted(chat.canonical(table.limit(0), "conv_id", "turn"))).count() == 0


def test_rows_keep_their_roles(spark):
    rows = [(1, 0, "human", "a"), (1, 1, "gpt", "b"), (2, 0, "model", "x" * 2_000_000), (2, 1, "bot", None)]
    turns = chat.canonical(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "conv_id", "turn")
    got = {r["id"]: r for r in chat.digests(chat.formatted(turns)).collect()}
    for c in (1, 2):
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x or ''}\n" for k, _, r, x in rows if k == c).encode()).hexdigest()
        assert got[c]["loss_chars"] == 0


def test_layouts_by_fingerprint(spark):
    q, a = ("user", "Q"), ("assistant", "A")
    cases = [
        ({"messages": [{"role": "user", "content": "Q"}, {"role": "assistant", "content": "A"}], "extra": 1}, [q, a]),
        ({"conversations": [{"from": "human", "value": "Q"}, {"from": "gpt", "value": "A"}]}, [q, a]),
        ({"instruction": "Q", "input": "", "output": "A"}, [q, a]),
        ({"instruction": "Do", "input": "x", "output": None}, [("user", "Do\n\nx"), ("assistant", "")]),
        ({"system": "", "prompt": "Q", "response": "A"}, [q, a]),
        ({"prompt": "Q", "completion": "A", "meta": {"a": [1]}}, [q, a]),
        ({"data": {"messages": [{"content": "Q", "role": "user"}, {"content": "A", "role": "bot"}]}}, [q, a]),
        ({"strange": 1}, None),
    ]
    table = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _) in enumerate(cases)] + [(90, "no json"), (91, None)], "id long, record string")
    got = {}
    for r in chat.canonical_json(table, "id", "record").orderBy("id", "turn").collect():
        got.setdefault(r["id"], []).append((r["role"], r["text"]))
    for i, (_, want) in enumerate(cases):
        assert got[i] == (want or [(None, None)])
    assert got[90] == got[91] == [(None, None)]
    typed = spark.createDataFrame([(1, {"messages": [{"role": "user", "content": "Q"}, {"role": None, "content": None}]})], "id long, data struct<messages: array<struct<role: string, content: string>>>")
    assert [tuple(r) for r in chat.canonical(typed, "id").collect()] == [(1, 0, "user", "Q"), (1, 1, "unknown", "")]
    flat = spark.createDataFrame([(1, "Q", None, "A")], "id long, instruction string, input string, output string")
    assert [tuple(r)[2:] for r in chat.canonical(flat, "id").collect()] == [q, a]


def test_archives(spark):
    big = "<p>" + "word é " * 300
    rows = [(i, f"http://www.Example.com/{i % 4}?q=a b", big if i % 3 else f"{big}{i}") for i in range(30)]
    rows += [(40, None, "small"), (41, "http://x.org/é\n", "small"), (42, "http://[bad", None), (None, "http://n.org/", big), (29, "http://again.org", big)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    files = warc.archive(pages)
    got = sorted((tuple(r) for r in warc.read_archives(spark, files, lines_a_task=1).collect()), key=str)
    best, want = {}, []
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            best[h] = max(i, best.get(h, i))
    for i, _, h in rows:
        data = (h or "").encode()
        copied = len(data) >= 1000 and sum(x[2] == h for x in rows) > 1
        refers = best[h] if copied and i != best[h] else None
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers))
    assert got == sorted(want, key=str)
    found = list(warc.lookup(files, "https://user@www.example.com/1?q=a b#top"))
    assert sorted(int(h["WARC-Record-ID"][10:-1]) for h, _ in found) == [i for i in range(30) if i % 4 == 1]
    assert list(warc.lookup(files, "http://absent.org/")) == [] and list(warc.lookup([], "x")) == []
    assert len(list(warc.lookup(files, None))) == 1
    assert warc.read_archives(spark, warc.archive(pages.limit(0))).count() == 0
    assert pages.select(F.count("*")).first()[0] == len(rows)


def test_lookup_over_many_blocks(spark):
    rows = [(i, f"http://h{i % 7}.example.org/p", f"body {i}") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    folder = warc.new_path(spark, "warc")
    files = warc.write_index(warc.write_archives(warc.marked(pages), folder), folder, lines=5)
    for k in range(7):
        found = list(warc.lookup(files, f"http://h{k}.example.org/p"))
        assert sorted(b.decode() for _, b in found) == sorted(f"body {i}" for i in range(200) if i % 7 == k)


def test_bad_records_are_rows_of_nulls(spark):
    hi = [{"role": "user", "content": "hi"}]
    records = [
        json.dumps({"data.messages": hi}),
        '{"messages":[{"role":"user","content":"\\ud800 half"}]}',
        "[" * 100_000,
        '{"messages":[]}',
        json.dumps({"prompt": "p", "messages": hi}),
        json.dumps({"prompt": "p", "response": "r", "output": "o"}),
        '{"messages":{"role":"user"}}',
        "nonsense",
        None,
        '{"messages":["x",{"role":null,"content":7}]}',
    ]
    table = spark.createDataFrame(list(enumerate(records)), "id long, record string")
    got = {}
    for r in chat.canonical_json(table, "id", "record").collect():
        got.setdefault(r["id"], []).append((r["turn"], r["role"], r["text"]))
    nothing = [(None, None, None)]
    assert got == {0: nothing, 1: [(0, "user", "\ufffd half")], 2: nothing, 4: [(0, "user", "hi")], 5: [(0, "user", "p"), (1, "assistant", "r")], 6: nothing, 7: nothing, 8: nothing, 9: [(0, "unknown", "7")]}


def test_known_fields_beside_a_layout(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hi", "other")], "conv_id long, turn long, role string, text string, prompt string")
    assert [tuple(r) for r in chat.canonical(rows, "conv_id", "turn").collect()] == [(1, 0, "user", "hi")]
    with pytest.raises(ValueError):
        chat.canonical(rows.drop("text"), "conv_id", "turn")


@pytest.mark.parametrize(
    "page, want",
    [
        ('<article><p>Some code here, for you.</p><pre><span class="token comment"># note</span> x = 1</pre></article>', "Some code here, for you.\n\n# note x = 1"),
        ("<article><p>Formula <math><mi>x</mi></math> here, fine.</p></article>", "Formula x here, fine."),
        ('<article><p>Intro text, of words.</p><section id="widgets"><p>How widgets are made, in short.</p></section></article>', "Intro text, of words.\n\nHow widgets are made, in short."),
        ('<div class="post"><h1>Headline</h1><div class="post-body"><p>The story text, long enough to count. More, and more.</p></div></div>', "Headline\n\nThe story text, long enough to count. More, and more."),
        ('<div class="text"><p>First block of text, with words.</p></div><div class="more"><p>Second block, too.</p></div>', "First block of text, with words.\n\nSecond block, too."),
        ('<div class="text"><p>First block of text, with words.</p></div><div class="nearby"><a href="/a">Some other page</a> <a href="/b">And one more page</a></div>', "First block of text, with words."),
    ],
)
def test_what_belongs_to_an_article(page, want):
    assert extract.main_text(f"<html><body>{page}</body></html>")[0] == want


OTHERS = ['<div class="comment-body"><p>I like it, really.</p></div>', '<div class="replies"><article><p>A reply, so long.</p></article></div>', '<div id="respond"><p>Leave a reply, please.</p></div>', '<div class="related-posts"><p>Read this too, friend.</p></div>', '<div class="social-share"><p>Share it with all.</p></div>', '<section id="comments" class="x"><p>Some say so, others not.</p></section>']


@pytest.mark.parametrize("other", OTHERS)
@pytest.mark.parametrize("inside", ["<article>{}{}</article>", "<article>{}</article>{}", '<div class="post-body">{}{}</div>', '<main><div class="entry">{}</div>{}</main>'])
def test_what_does_not(other, inside):
    text = "The real text of the page, with words enough."
    assert extract.main_text("<body>" + inside.format(f"<p>{text}</p>", other) + "</body>")[0] == text
