"""HTML wrappers, source divergence and phrase collocations: against plain versions, on hard rows and hand-made pages."""

import re
from collections import Counter, defaultdict
from html import unescape

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import byte_terms, collocations, divergence
from lectern.llm import html_wrappers as hw

from .test_llm import hard_rows, table

PLAIN = """<!doctype html><html><head><title>Site: A</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href=/>Home</a><li><a href="/b">B</a></ul></nav><div class="cookie-notice">We use cookies.</div>
<main id=main><article><header><h2>Head &amp; tail</h2></header><p>One&nbsp;<b>two</b>
 three<p>Four<br>five<div class="share-buttons"><a>Tweet</a></div><ul><li>item one<li>item two</ul><!-- a < b > --><script>document.write("</p><p>no")</script><blockquote>Said.</blockquote>
<form>Name <input></form></article><section id="comments"><p>Nice one!</p></section></main><aside>Aside</aside><footer>(c)</footer>"""


def alone(page):
    root = hw.parse(page)
    items = hw.expression(root)
    stats = {p: [1, 1, 0, 0, 1] for p in hw.slots(items)}
    keep, number = set(hw.article_slots(items, stats)), {p: k for k, p in enumerate(hw.slots(items))}
    return "\n".join(t for p, leaf in hw.leaves(root) if number[p] in keep and (t := hw.clean(leaf)))


def test_article_of_one_page():
    assert alone(PLAIN) == "Head & tail\nOne two three\nFour five\nitem one\nitem two\nSaid."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""), ("just text", "just text"), ("<p>a < b &lt; c", "a < b < c"), ("<p>a<!-- open", "a"), ("<p>a<script>open", "a"), ("<p>a<div", "a"), ("<article><p title='x > y'>a</p></article>", "a"),
        ("<article><p>a<br> <br>b</article>", "a\nb"), ("<article>x<p>y</p>z</article>", "x\ny\nz"), ("<ARTICLE><P>A</P></ARTICLE>", "A"), ("<article><p>&#65;&#x42;&eacute;&copy 1</p></article>", "ABé© 1"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a\nb\nc"), ("<article><p>a</article></div></p><footer>f", "a"), ("<noscript>on</noscript><article>t</article>", "t"),
        ("<div class='content with-sidebar'><p>t</p></div><div class=sidebar>s</div>", "t"), ("<article><p>a</p><div hidden>b</div></article>", "a"),
    ],
)
def test_pieces_of_html(page, text):
    assert alone(page) == text


labels = st.sampled_from("a b c d".split())
trees = st.recursive(st.just("#"), lambda inner: st.lists(st.one_of(st.just("#"), st.tuples(labels, st.lists(inner, max_size=4))), max_size=5), max_leaves=14)


def node_of(tree, label=""):
    node = hw.Node(label)
    for c in tree if isinstance(tree, list) else []:
        if c == "#":
            node.children.append(hw.Node("#"))
        elif isinstance(c, tuple):
            node.children.append(node_of([x if isinstance(x, (str, tuple)) else ("x", x) for x in c[1]], c[0]))
        else:
            node.children.append(node_of(c, "x"))
    return node


@settings(max_examples=150, deadline=None)
@given(st.lists(trees, min_size=1, max_size=4))
def test_wrapper_takes_every_page_it_was_made_of(made):
    pages = [node_of(t) for t in made]
    wrapper = hw.expression(pages[0])
    for p in pages[1:]:
        wrapper = hw.aligned(wrapper, hw.expression(p))
    assert len(set(hw.slots(wrapper))) == len(list(hw.slots(wrapper)))  # a slot's path says which it is
    for p in pages:
        assert set(hw.slots(hw.expression(p))) <= set(hw.slots(wrapper))
        if len(hw.tokens(p)) < 60:
            assert re.fullmatch(hw.pattern(wrapper), hw.tokens(p))


def test_extraction_by_host(spark):
    frame = "<body><div>Daily &mdash; all rights</div><div><p>{}</p><ul><li><a>more</a> on</li></ul></div><h6>Printed daily</h6></body>"
    rows = [(k, f"http://x.org/{k}", frame.format(f"Story {k}</p><p>goes on")) for k in range(5)]
    rows += [(10, None, None), (11, "nonsense", ""), (12, "https://me@Y.org:80/a", PLAIN), (12, "https://me@Y.org:80/a", PLAIN), (None, "https://y.org", "<p>" + "word " * 200_000)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, form int")
    found = hw.extract(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(((r.page_id, r.text) for r in found.collect()), key=str)
    assert Counter(got)[12, alone(PLAIN)] == 2 and (10, "") in got and (11, "") in got
    for k in range(5):
        assert (k, f"Story {k}\ngoes on") in got  # the frame, the same on all pages, and the menu go
    assert (None, ("word " * 200_000).strip()) in got
    assert all(r.n_chars == len(r.text) for r in found.collect())
    assert hw.extract(pages.limit(0)).collect() == []


def test_registered_pages(spark):
    from lectern.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op11_html_wrappers"](spark, sf).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"</?(?:b|br)>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.url == pages[r.page_id].url and r.n_chars == len(r.text)


def words_of(text, pattern):
    return [w.decode() for w in re.findall(pattern, re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))]


texts = st.lists(st.tuples(st.sampled_from([0, 1]), st.text(alphabet="aAbZéß日 \t\n.,1_", max_size=30)), max_size=12)


@settings(max_examples=150, deadline=None)
@given(texts, st.booleans())
def test_byte_terms(rows, weak):
    import pyarrow as pa

    seeds = np.array([k for k, _ in rows], np.uint64)
    with pytest.MonkeyPatch.context() as patch:
        if weak:  # hashes that collide: bytes decide
            patch.setattr(byte_terms.xxhash, "xxh3_64_intdigest", lambda data, seed=0: len(data) % 2)
        t = byte_terms.Terms(pa.chunked_array([pa.array([x for _, x in rows], pa.string())]), divergence.LETTERS, seeds)
    plain = [(k, w, seed) for k, (seed, x) in enumerate(rows) for w in words_of(x, rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")]
    words = t.words().to_pylist()
    assert [(int(r), words[g]) for r, g in zip(t.row, t.group, strict=True)] == [(k, w) for k, w, _ in plain]
    assert len(words) == len({(w, s) for _, w, s in plain}) == len(set(zip(words, seeds[t.row[t.first]].tolist(), strict=True)))


def plain_divergence(rows, least, best):
    docs = [(lang or "", source or "", words_of(text or "", rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(w for d in own for w in set(d[2]))
        kept = sorted(w for w, n in df.items() if n >= least)
        counts = defaultdict(Counter)
        for _, source, words in own:
            counts[source].update(w for w in words if df[w] >= least)
            counts[None].update(w for w in words if df[w] >= least)
        p = {s: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept} for s, c in counts.items()}
        for s in p:
            if s is None:
                continue
            pair = [(-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode()) for o in p if o not in (s, None)]
            term = [(p[None][w] - p[s][w], w.encode()) for w in kept if counts[s][w] and p[s][w] > p[None][w]]
            out += [(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(sorted(pair))]
            out += [(lang, s, "term", w.decode(), -v, k + 1) for k, (v, w) in enumerate(sorted(term)[:best])]
    return sorted(out)


def test_divergence_against_plain(spark):
    rng = np.random.default_rng(5)
    vocabulary = ["alpha", "Beta", "gamma", "été", "日本", "x", "zeta"]
    rows = [(" ".join(rng.choice(vocabulary, rng.integers(0, 30), p=[0.4, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05])) + ".", ["en", "de", None][k % 3], ["s1", "s2", None, "s4"][k * 7 % 4]) for k in range(60)]
    rows += [(None, "en", "quiet"), ("", "fr", "a"), ("one two", "fr", "b"), ("alpha " * 100_000, "de", "s1"), rows[0], rows[0]]
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], "text string, lang string, source string, n int, term string")
    for least, best in ((5, 2), (1, 50), (1000, 3)):
        found = divergence.divergence(docs, least, best)
        assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(map(tuple, found.collect())) == plain_divergence(rows, least, best)
    assert divergence.divergence(docs.limit(0)).collect() == []


def test_distances_and_shares():
    rng = np.random.default_rng(1)
    for rows, width in ((1, 1), (4, 7), (9, 40)):
        dense = np.where(rng.random((rows, width)) < 0.4, rng.integers(1, 10**9, (rows, width)), 0)
        none = rng.integers(1, 10**6, rows)
        row, place = np.nonzero(dense)
        first = np.searchsorted(row, np.arange(rows + 1))
        whole = np.where(dense > 0, dense, none[:, None])
        assert (divergence.distances(first, place, dense[row, place], none, width) == np.abs(whole[:, None] - whole[None]).sum(axis=2)).all()
    counts = [0, 1, 7, 10**12, 3 * 10**14]
    assert divergence.share(np.array(counts), 10**15, 12_345).tolist() == [1 + 10**9 * (c + 5) // (10**15 + 5 * 12_345) for c in counts]


def plain_collocations(rows, least, best):
    out = []
    by_lang = defaultdict(list)
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        by_lang["und" if lang is None else lang] += [re.findall(r"[^\x20\x09]+", piece) for piece in re.split(r"[.,;:!?\x0A-\x0D]", low)]
    for lang, pieces in by_lang.items():
        f = Counter(tuple(p[i : i + m]) for p in pieces for m in range(1, 5) for i in range(len(p) - m + 1))
        found = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        rows = []
        for g, a in found.items():
            if any(100 * b >= 80 * a and len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h, b in found.items()):
                continue
            score, _, l, r = min((2000000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))  # noqa: E741
            rows.append((-score, -a, " ".join(g).encode(), l, r))
        n = sum(len(p) for p in pieces)
        out += [(lang, k + 1, p.decode(), -a, l, r, n, -s) for k, (s, a, p, l, r) in enumerate(sorted(rows)[:best])]
    return sorted(out)


def test_collocations_against_plain(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vocabulary = ["the", "The", "new", "york", "times", "of", "été", "a-b", "\x00z", "rare"]
    text = lambda n: "".join(w + rng.choice([" ", "  ", "\t", ". ", "\n"], p=[0.7, 0.1, 0.1, 0.05, 0.05]) for w in rng.choice(vocabulary, n, p=[0.2, 0.1, 0.15, 0.15, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05]))
    rows = [(text(rng.integers(0, 60)), ["en", "de", None][k % 3]) for k in range(60)]
    rows += [(None, "en"), ("", "fr"), ("one two", "fr"), ("new york " * 50_000, "de"), rows[0], rows[0]]
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], "text string, lang string, a int, phrase string")
    for least, best in ((3, 2000), (10, 7), (10**6, 5)):
        found = collocations.collocations(docs, least, best)
        assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, found.collect())) == plain_collocations(rows, least, best)
    # pivots in several buckets, a sketch whose cells are shared by all words
    monkeypatch.setattr(collocations, "PIVOT", 10)
    monkeypatch.setattr(collocations, "BUCKET", 100)
    monkeypatch.setattr(collocations, "CELLS", 4)
    assert sorted(map(tuple, collocations.collocations(docs, 4, 50).collect())) == plain_collocations(rows, 4, 50)
    assert collocations.collocations(docs.limit(0)).collect() == []


def test_hard_rows(spark):
    docs = table(spark, hard_rows())
    rows = [(r.text, r.lang, r.source) for r in docs.select("text", "lang", "source").collect()]
    assert sorted(map(tuple, divergence.divergence(docs, 1, 5).collect())) == plain_divergence(rows, 1, 5)
    assert sorted(map(tuple, collocations.collocations(docs, 2, 100).collect())) == plain_collocations([r[:2] for r in rows], 2, 100)
