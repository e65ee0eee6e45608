"""Queries that SQL cannot express, against plain Python on the smallest driver tables."""

import html
import os
import random
import re
from collections import Counter, defaultdict
from difflib import SequenceMatcher
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import similarity
from lectern.operators import dedupe, enrich, outline
from lectern.plans.adapters import Views
from lectern.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def views(spark):
    return Views(spark, SF)


def rows(df):
    return [r.asDict() for r in df.collect()]


def norm(text):
    import unicodedata

    bare = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").lower()
    return re.sub(" +", " ", re.sub("[^a-z0-9 ]", " ", bare)).strip()


def joined(head, tail):
    head, tail = head.rstrip(), tail.lstrip()
    if not head:
        return tail
    return head[:-1] + tail if head.endswith("-") and not head.endswith("--") else f"{head} {tail}"


def plain_headings(lines):
    """page, y, ord, text, size, score of the headings of each document, from scored lines."""
    found = defaultdict(list)
    for r in sorted((r for r in lines if r["score"] >= outline.THRESHOLD), key=lambda r: (r["doc_id"], r["page"], r["y"], r["ord"])):
        own, text = found[r["doc_id"]], r["text"].strip(" ")
        if own:
            h = own[-1]
            dy = r["y"] - h["y"]
            if (h["page"], h["size"], h["bold"]) == (r["page"], r["size"], r["bold"]) and h["n"] < 3 and 0 < dy <= 1.8 * max(h["y1"] - h["y"], 1):
                h |= {"text": joined(h["text"], text), "y1": r["y1"], "score": max(h["score"], r["score"]), "n": h["n"] + 1}
                continue
        own.append({**r, "text": text, "n": 1})
    for doc, own in found.items():
        pages = defaultdict(set)
        for h in own:
            pages[h["text"].strip().lower()].add(h["page"])
        found[doc] = [h for h in own if len(pages[h["text"].strip().lower()]) < 3]
    return found


@pytest.fixture(scope="module")
def headings(views):
    return plain_headings(rows(outline.scored_lines(views.pdf_lines)))


def test_heading_candidates(spark, headings):
    expected = sorted((d, h["ord"], h["page"], h["text"], h["score"]) for d, own in headings.items() for h in own)
    got = rows(QUERIES["heading_candidates"](spark, SF))
    assert sorted((r["doc_id"], r["ord"], r["page"], r["text"], r["score"]) for r in got) == expected and not any(r["truncated"] for r in got)


def test_heading_cap(views, headings):
    expected = set()
    for d, own in headings.items():
        expected |= {(d, h["ord"]) for h in sorted(own, key=lambda h: (-h["score"], h["page"], h["y"], h["ord"]))[:2]}
    got = rows(outline.heading_candidates(views.pdf_lines, cap=2))
    assert {(r["doc_id"], r["ord"]) for r in got} == expected
    assert all(r["truncated"] == (len(headings[r["doc_id"]]) > 2) for r in got)


def depth_of(text):
    m = re.match(r"\s*(\d{1,2}(?:\.\d{1,2}){0,3})\.?\s+\S", text)
    return m[1].count(".") + 1 if m else 0


def plain_levels(own, most=4):
    depths = [depth_of(h["text"]) for h in own]
    numbered = sum(d > 0 for d in depths) >= max(3, 0.4 * len(own))
    pages = defaultdict(set)
    for h in own:
        pages[h["size"]].add(h["page"])
    sizes = sorted((s for s, p in pages.items() if len(p) >= 3), reverse=True) or sorted(pages, reverse=True)
    rank = lambda size: 1 + min(range(len(sizes)), key=lambda k: (abs(sizes[k] - size), k))
    return {h["ord"]: min(d if numbered and d else rank(h["size"]), most) for h, d in zip(own, depths, strict=True)}


def test_heading_levels(spark, headings):
    expected = {(d, o): n for d, own in headings.items() for o, n in plain_levels(own).items()}
    assert {(r["doc_id"], r["ord"]): r["level"] for r in rows(QUERIES["heading_levels"](spark, SF))} == expected


def test_levels_of_numbered_headings(spark):
    own = [{"page": p, "y": 1.0, "ord": k, "text": t, "size": s, "score": 9} for k, (p, t, s) in enumerate([(1, "1 One", 14.0), (2, "1.1 Two", 12.0), (2, "Plain", 14.0), (3, "1.1.2.3 Deep", 12.0), (4, "Last", 11.0), (5, "Again", 14.0), (6, "More", 14.0)])]
    df = spark.createDataFrame([{"doc_id": 1, **h} for h in own], "doc_id long, page int, y double, ord long, text string, size double, score int")
    got = {r.ord: r.level for r in outline.heading_levels(df).collect()}
    assert got == plain_levels(own) == {0: 1, 1: 2, 2: 1, 3: 4, 4: 2, 5: 1, 6: 1} or got == plain_levels(own)


@pytest.mark.parametrize(
    ("text", "points"),
    [("Chapter 4", 3), ("Anexo IV", 3), ("IV. Title", 3), ("capítulo 12", 3), ("3.1 Scope", 3), ("Chapters of 4", 0), ("123 Apples", 0)],
)
def test_numbered_headings_score(spark, text, points):
    plain = {"doc_id": 1, "page": 1, "y": 300.0, "y1": 310.0, "x0": 72.0, "x1": 120.0, "size": 10.0, "bold": False, "page_height": 600.0, "page_width": 400.0, "lines_in_block": 9, "body": 10.0, "measure": 300.0}
    kinds = "doc_id long, page int, y double, y1 double, x0 double, x1 double, size double, bold boolean, page_height double, page_width double, lines_in_block int, body double, measure double, text string"
    assert spark.createDataFrame([{**plain, "text": text}], kinds).select(outline.heading_score()).first()[0] == 1 + points


@pytest.mark.parametrize("text", ["Figura 3", "ecuación 2", "GRÁFICO 1", "Plate 7", "First part; second part", "He said: (yes)"])
def test_captions_and_prose_are_no_headings(spark, text):
    df = spark.createDataFrame([(text, 300.0, 72.0, 120.0, 20.0, True, 600.0, 400.0, 1, 10.0, 300.0)], "text string, y double, x0 double, x1 double, size double, bold boolean, page_height double, page_width double, lines_in_block int, body double, measure double")
    assert df.select(outline.heading_score()).first()[0] == 0


def plain_search(entries, pages, doc, moved=False):
    """Marks entries found near their page, in place."""
    for e in entries:
        needle = norm(e["title"])[:40]
        if len(needle) < 8:
            continue
        for turn, d in enumerate((0, 1, -1, 2, -2)):
            if needle in norm(pages.get((doc, e["page"] + d), "")):
                e |= {"page": e["page"] + d, "confidence": "verified" if turn == 0 else "verified-shifted"}
                break


def test_verify_toc_pages(spark, views):
    lines = rows(views.pdf_lines)
    pages, last = defaultdict(list), Counter()
    for r in sorted(lines, key=lambda r: r["ord"]):
        pages[r["doc_id"], r["page"]].append(r["text"])
        last[r["doc_id"]] = max(last[r["doc_id"]], r["page"])
    pages = {k: " ".join(v) for k, v in pages.items()}
    title = {(r["doc_id"], r["ord"]): (r["text"], r["page"] - r["doc_id"] % 5, r["ord"] % 6 == 3) for r in lines}
    placed = defaultdict(list)
    for r in rows(QUERIES["toc_resolve_pages"](spark, SF)):
        if r["page"] is not None:
            text, printed, roman = title[r["doc_id"], r["ord"]]
            placed[r["doc_id"]].append({**r, "title": text, "printed": printed, "roman": roman})
    for doc, own in placed.items():
        plain_search(own, pages, doc)
        for series in (False, True):
            some = [e for e in own if e["roman"] == series]
            sure = [e["page"] - e["printed"] for e in some if e["confidence"].startswith("verified")]
            if len(sure) < 3:
                continue
            moved = [e for e in some if not e["confidence"].startswith("verified") and 1 <= e["printed"] + int(median(sure)) <= last[doc] and e["printed"] + int(median(sure)) != e["page"]]
            for e in moved:
                e |= {"page": e["printed"] + int(median(sure)), "confidence": "consensus"}
            plain_search(moved, pages, doc)
    expected = sorted((d, e["ord"], e["page"], e["confidence"]) for d, own in placed.items() for e in own)
    got = sorted((r["doc_id"], r["ord"], r["page"], r["confidence"]) for r in rows(QUERIES["verify_toc_pages"](spark, SF)))
    assert got == expected


def test_moved_entries_are_searched_again(spark):
    entry = "doc_id long, ord long, title string, printed int, roman boolean, page int, confidence string"
    pages = spark.createDataFrame([(1, p, f"chapter number {p} begins") for p in range(1, 30)], "doc_id long, page int, text string")
    e = [(1, k, f"Chapter number {k + 10}", k, False, k + 10, "labels") for k in (1, 2, 3)] + [(1, 9, "Chapter number 20", 9, False, 9, "none"), (1, 10, "nowhere to be found", 5, False, 5, "none"), (1, 11, "nowhere either", 25, False, 25, "none")]
    found = outline.repair_pages(outline.verify_pages(spark.createDataFrame(e, entry), pages), pages)
    got = {r.ord: (r.page, r.confidence) for r in found.collect()}
    assert got[9] == (20, "verified-shifted") and got[10] == (15, "consensus") and got[11] == (25, "none")


def plain_title(text):
    """The title of a printed contents entry, if the text is one."""
    edge = r"\s.·•․‥…‧_\-–—"
    line = re.sub(r"\s+", " ", text.replace("\u00a0", " ")).strip()
    m = re.match(rf"(.+?[^{edge}])[{edge}]{{2,}}(\d{{1,4}}|[ivxlcdmIVXLCDM]{{1,15}})$", line) or re.match(r"(.+?\S)\s+(\d{1,4})$", line)
    if not m:
        return None
    title, page = re.sub(f"^[{edge}]+|[{edge}]+$", "", m[1]), m[2].lower()
    value = dict(zip("ivxlcdm", (1, 5, 10, 50, 100, 500, 1000), strict=True))
    n = int(page) if page.isdigit() else sum(-value[c] if value[c] < value.get(d, 0) else value[c] for c, d in zip(page, page[1:] + " ", strict=True))
    good = len(title) >= 2 and re.search(r"[^\W\d_]", title) and title.lower() not in outline.STRUCTURAL and n > 0 and (page.isdigit() or n <= 200)
    return title if good else None


def plain_number(text):
    """The arabic printed number of a contents line, None for roman ones and lines that are none."""
    return int(m[1]) if plain_title(text) and (m := re.search(r"(\d{1,4})$", text.strip())) else None


def plain_linked(links, lines):
    """Walks each page's lines in order; a line without a link, or that is no title, ends the entry before."""
    by_page = defaultdict(list)
    for x in links:
        by_page[x["doc_id"], x["page"]].append(x)
    edge = " \t.·•․‥…‧_-–—"
    docs = defaultdict(list)
    before = None
    for t in sorted(lines, key=lambda t: (t["doc_id"], t["page"], t["ord"])):
        boxes = sorted(by_page[t["doc_id"], t["page"]], key=lambda x: x["link_ord"])
        target = next((x["target"] for x in boxes if covered(x, t) > 0.3), None)
        part = plain_title(t["text"]) or t["text"].strip(edge)
        if target is None or len(part) < 2 or not re.search(r"[^\W\d_]", part) or re.match(outline.CONTENTS[5:].replace(r"\b(", "(", 1), part, re.I):
            before = None
            continue
        out = docs[t["doc_id"]]
        below = before and (before["doc_id"], before["page"]) == (t["doc_id"], t["page"]) and 0 < t["y"] - before["y"] <= 1.8 * max(before["y1"] - before["y"], 1)
        if below and out[-1]["page"] == target and not part[0].isupper() and not part[0].isdigit():
            out[-1]["title"] = joined(out[-1]["title"], part)
        else:
            out.append({"doc_id": t["doc_id"], "ord": t["ord"], "title": part, "printed": plain_number(t["text"]), "page": target})
        before = t
    for out in docs.values():
        votes = Counter(e["page"] - e["printed"] for e in out if e["printed"])
        if votes and votes.most_common(1)[0][1] >= 3:
            for e in out:
                m = None if e["printed"] else re.match(r"(.*?[^\W\d_])\s*(\d{1,4})$", e["title"], re.S)
                if m and int(m[2]) + votes.most_common(1)[0][0] == e["page"]:
                    e["title"], e["printed"] = m[1].strip(), int(m[2])
    return sorted((e["doc_id"], e["ord"], e["title"], e["printed"] or 0, e["page"]) for out in docs.values() for e in out)


def covered(x, t):
    wide, high = min(x["x1"], t["x1"]) - max(x["x0"], t["x0"]), min(x["y1"], t["y1"]) - max(x["y"], t["y"])
    return max(wide, 0) * max(high, 0) / max((t["x1"] - t["x0"]) * (t["y1"] - t["y"]), 1e-9)


def test_linked_contents(spark, views):
    got = sorted((r["doc_id"], r["ord"], r["title"], r["printed"] or 0, r["page"]) for r in rows(QUERIES["linked_contents"](spark, SF)))
    assert got == plain_linked(rows(views.links), rows(views.toc_lines))


LINE = "doc_id long, page int, ord long, text string, x0 double, x1 double, y double, y1 double"


def plain_columns(lines):
    """Numbers in reading order; each takes the free title that ends furthest right of those left of it at its height."""
    taken = {}
    for n in (t for t in lines if re.fullmatch(r"\d{1,4}|[ivxlcdm]{1,15}", t[3].strip(), re.I)):
        fits = [t for t in lines if not re.fullmatch(r"\d{1,4}|[ivxlcdm]{1,15}", t[3].strip(), re.I) and t[2] not in taken and t[5] <= n[4] + 2 and t[6] - 1 <= (n[6] + n[7]) / 2 <= t[7] + 1]
        if fits:
            taken[max(fits, key=lambda t: (t[5], -t[2]))[2]] = n[2]
    return sorted(taken.items())


def test_columns_are_paired_in_reading_order(spark):
    # two titles and two numbers on one baseline, a tall title, a title that ends one unit past the number's left edge
    told = [("Left", 60, 200, 10, 20), ("Right", 210, 300, 10, 20), ("12", 310, 320, 10, 20), ("13", 330, 340, 10, 20), ("Tall", 60, 200, 40, 90), ("14", 310, 320, 70, 80), ("Near", 60, 311, 100, 110), ("xv", 310, 320, 100, 110)]
    probe = [(1, 1, k, t, float(a), float(b), float(y), float(y1)) for k, (t, a, b, y, y1) in enumerate(told)]
    got = outline.pair_columns(spark.createDataFrame(probe, LINE))
    assert sorted((r.title, r.printed) for r in got.collect()) == [("Left", "13"), ("Near", "xv"), ("Right", "12"), ("Tall", "14")]
    rng = random.Random(4)
    pages = []
    for page in range(1, 30):
        y = [rng.choice(range(0, 80, 5)) for _ in range(14)]
        pages.append([(7, page, 100 * page + k, rng.choice(["Title", "Other", "9", "iv", "120"]), float(rng.choice([50, 300])), float(rng.choice([200, 280, 301, 330])), float(v), float(v + rng.choice([8, 12, 40]))) for k, v in enumerate(y)])
    got = defaultdict(list)
    for r in outline.pair_columns(spark.createDataFrame([x for p in pages for x in p], LINE)).collect():
        got[r.page].append((r.ord, r.number_ord))
    assert {p: sorted(v) for p, v in got.items()} == {p[0][1]: plain_columns(p) for p in pages if plain_columns(p)}


def test_titles_keep_their_years(spark):
    kinds = "doc_id long, ord long, title string, printed int, roman boolean, link_page int"
    years = [(1, k, f"Title {c} {1900 + k}", None, None, 1905 + k) for k, c in enumerate("abcd")]  # no row that was read, no vote
    read = [(2, k, f"Read {k}", 10 + k, False, 15 + k) for k in range(3)] + [(2, 9, "Glued16", None, None, 21), (2, 10, "In 1950", None, None, 30), (2, 11, "Of 20161", None, None, 166), (2, 12, "Ends 7) 17", None, None, 22), (2, 13, "Roman 18", 4, True, 23)]
    few = [(3, 0, "a", 1, False, 6), (3, 1, "b", 2, False, 7), (3, 2, "Glued3", None, None, 8)]
    got = {(r.doc_id, r.ord): (r.title, r.printed) for r in outline.glued_numbers(spark.createDataFrame(years + read + few, kinds)).collect()}
    assert [got[1, k][0] for k in range(4)] == [y[2] for y in years]
    assert [got[2, k] for k in range(9, 14)] == [("Glued", 16), ("In 1950", None), ("Of 20161", None), ("Ends 7) 17", None), ("Roman 18", 4)]
    assert got[3, 2] == ("Glued3", None)


def test_columns_of_contents(spark):
    """Titles above what a number claimed are its beginning; a page with fewer than four pairs gives none; without columns a run's own rows stay."""
    text = ["Contents", "First of", "two lines", "Second", "Third-", "part", "Fourth"]
    y = [10, 30, 44, 80, 110, 124, 160]
    lines = [(1, 1, 2 * k, t, 70.0 + k, 200.0, float(v), v + 10.0) for k, (t, v) in enumerate(zip(text, y, strict=True))]
    lines += [(1, 1, 2 * k + 1, n, 300.0, 310.0, float(y[k]), y[k] + 10.0) for k, n in ((2, "7"), (3, "9"), (5, "xi"), (6, "14"))]
    lines += [(2, 1, k, t, 70.0, 200.0, 20.0 * k, 20.0 * k + 10) for k, t in enumerate(["Contents", "Only ..... 3", "Two ..... 5", "words"])]
    runs = spark.createDataFrame([(1, 1, 1, True), (2, 1, 1, True)], "doc_id long, first int, last int, titled boolean")
    got = sorted((r.doc_id, r.ord, r.title, r.printed, r.roman, r.x0) for r in outline.printed_contents(runs, spark.createDataFrame(lines, LINE)).collect())
    assert got == [(1, 4, "First of two lines", 7, False, 71.0), (1, 6, "Second", 9, False, 73.0), (1, 10, "Thirdpart", 11, True, 74.0), (1, 12, "Fourth", 14, False, 76.0), (2, 1, "Only", 3, False, 70.0), (2, 2, "Two", 5, False, 70.0)]


def test_similar_is_exact(spark):
    from lectern.functions import text as T

    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    pairs = [(word(rng.randrange(0, 24)), word(rng.randrange(0, 24))) for _ in range(400)] + [("a" * 10, "a" * 9 + "b"), ("a" * 20, "a" * 18 + "bb"), ("", ""), ("", "a")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", *(T.similar(F.col("a"), F.col("b"), s).alias(f"s{i}") for i, s in enumerate((0.9, 0.5, 0.75)))).collect()

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for r in got:
        near = 0.0 if not r.a or not r.b else 1.0 - distance(r.a, r.b) / max(len(r.a), len(r.b))
        assert (r.s0, r.s1, r.s2) == tuple(r.a == r.b or bool(r.a and r.b and near >= s) for s in (0.9, 0.5, 0.75))


def test_linked_pages_are_contents(spark, views):
    """Pages whose rows are links, of a document's first part, count without printed numbers; lists of exhibits do not."""
    text = [(1, p, o, t) for p, lines in ((1, ["Sumario", "a", "b", "c", "d"]), (2, ["Índice de tablas", "one", "two", "three", "four"]), (3, ["Mapa 1", "Mapa 2", "Tabla 3", "Foto 4", "x"]), (9, ["Contents", "a", "b", "c", "d"])) for o, t in enumerate(lines)]
    lines = spark.createDataFrame([(d, p, 10 * p + o, t, 70.0, 200.0, 20.0 * o, 20.0 * o + 10) for d, p, o, t in text], "doc_id long, page int, ord long, text string, x0 double, x1 double, y double, y1 double")
    links = spark.createDataFrame([(1, p) for p in (1, 2, 3, 9) for _ in range(4)], "doc_id long, page int")
    assert [(r.page, r.rows, r.titled) for r in outline.contents_pages(lines, links).collect()] == [(1, 4, True)]
    count = spark.createDataFrame([(1, 50)], "doc_id long, page_count int")
    assert sorted(r.page for r in outline.contents_pages(lines, links, count).collect()) == [1, 9]


def plain_normalize(entries, most):
    out, asked = [], []
    for level, title, page in entries:
        title, page, level = re.sub(r"\s+", " ", title).strip(), max(page, 1), min(max(level, 1), most)
        if not title or (asked and asked[-1] == (level, title, page)):
            continue
        asked.append((level, title, page))
        out.append((min(level, (out[-1][0] if out else 0) + 1), title, page))
    return out


def test_outline_normalize(spark, views):
    docs = defaultdict(list)
    for r in sorted(rows(views.pdf_lines), key=lambda r: r["ord"]):
        docs[r["doc_id"]].append((1 + r["ord"] % 4 * 2, r["text"], r["page"] * 2 - r["ord"] % 3))
    expected = []
    for d, entries in docs.items():
        own = plain_normalize(entries, 4)
        back = sum(b[2] < a[2] for a, b in zip(own, own[1:], strict=False))
        expected += [(d, i, *e, back) for i, e in enumerate(own)]
    got = [(r["doc_id"], r["i"], r["level"], r["title"], r["page"], r["n_backwards"]) for r in rows(QUERIES["outline_normalize"](spark, SF))]
    assert sorted(got) == sorted(expected)


def test_outline_text(spark):
    assert all(r["same"] for r in rows(QUERIES["outline_text_roundtrip"](spark, SF)))
    text = "# a comment\nOne\t1\n  Two  parts\t2\n\n\t\tThree   7\n"
    got = spark.createDataFrame([(text,)], "t string").select(outline.parse(F.col("t")).alias("e")).first().e
    assert [(x.level, x.title, x.page) for x in got] == [(1, "One", 1), (2, "Two  parts", 2), (3, "Three", 7)]


def plain_accepts(item, c):
    """(similarity, reason) by the rules of verification; a similarity that lengths rule out is not computed."""
    a, b = norm(item["title"]), norm(c["title"])
    s = SequenceMatcher(None, a, b).ratio() if a and b else 0.0
    year = re.search(r"\d{4}", item["date"] or "")
    surname = norm((f"{item['first_name']} {item['last_name']}".split() or [""])[-1])
    if s < (0.92 if year or surname else 0.98):
        return s, "title"
    if year and c["year"] is not None and abs(int(year[0]) - c["year"]) > 1:
        return s, "year"
    return s, "ok" if surname in norm(c["author"]) else "author"


def test_enrich_verify(spark, views):
    items = {r["key"]: r for r in rows(views.items)}
    expected = {(c["item_key"], c["rank"]): plain_accepts(items[c["item_key"]], c) for c in rows(views.candidates) if c["item_key"] in items}
    got = {(r["item_key"], r["rank"]): r for r in rows(QUERIES["enrich_verify"](spark, SF))}
    assert set(got) == set(expected)
    for k, (s, reason) in expected.items():
        assert got[k]["reason"] == reason, (k, s)
        assert got[k]["similarity"] is None and reason == "title" or abs(got[k]["similarity"] - s) < 1e-6


def test_enrich_pick(spark, views):
    items = {r["key"]: r for r in rows(views.items)}
    accepted, reasons = {}, defaultdict(dict)
    for c in sorted(rows(views.candidates), key=lambda c: (c["item_key"], c["rank"])):
        if c["item_key"] in items and not (items[c["item_key"]]["doi"] or "").strip():
            s, reason = plain_accepts(items[c["item_key"]], c)
            reasons[c["item_key"]][c["rank"]] = reason
            if reason == "ok":
                accepted.setdefault(c["item_key"], c)
    got = {r["item_key"]: r for r in rows(enrich.pick(views.items, views.candidates, "doi"))}
    assert {k for k, r in got.items() if r["reason"] == "ok"} == set(accepted)
    histogram = Counter("no-result" if not own else own[max(own)] for own in (reasons[k] for k, r in items.items() if not (r["doi"] or "").strip() and k not in accepted))
    assert {r["reason"]: r["n"] for r in rows(QUERIES["enrich_rejections"](spark, SF))} == dict(histogram)


def test_clean_abstract(spark):
    pages = {r["page_id"]: r["html"] for r in rows(Views(spark, SF).table("pages"))}
    for r in rows(QUERIES["clean_abstract"](spark, SF)):
        text = re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]+>", " ", pages[r["page_id"]]))).strip()
        assert r["abstract"] == re.sub(r"^(Abstract|Resumen|ABSTRACT|RESUMEN)[\s:.\-‐-―]*", "", text)


def test_unescape(spark):
    from lectern.functions import text as T

    texts = ["", None, "no reference", "&amp;&lt;&gt;", "&eacute;&EACUTE;&eacute", "&ampfoo &notin; &notit; &nope;", "&#233;&#xE9&#0;&#128;&#x9f;&#13;&#11;&#xD800;&#1114112;&#99999999999;&#x1F600;&#xFFFF;", "&;&&#;&#x;&", "&NotEqualTilde;&fjlig;x&", "a &#38;amp; b", "&copy2020 &copy;2020 &thetasym; &AMP"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("u", T.unescape("t"))
    assert {r.i: r.u for r in df.collect()} == {i: None if t is None else html.unescape(t) for i, t in enumerate(texts)}


def similar(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return 1 - d[-1] / max(len(a), len(b), 1)


def alike_titles():
    """Titles with a common beginning, repetitive and short ones among them, and edits of each."""
    import random

    rng = random.Random(3)
    base = ["common beginning of " + " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(rng.randrange(0, 9))) for _ in range(40)] + ["common" + "a" * n for n in range(5, 40, 3)]
    titles = list(base)
    for t in base:
        for _ in range(3):
            x = list(t)
            for _ in range(rng.randrange(1, 6)):
                at = rng.randrange(6, len(x) + 1)
                x[at : at + rng.randrange(2)] = rng.choice("abcxyz ")
            titles.append("".join(x))
    rng.shuffle(titles)
    return titles


def plain_pairs(titles):
    key = [re.sub("[^a-z0-9]+", " ", t.lower()).strip() for t in titles]
    count = Counter(key)
    alone = [i for i in range(len(key)) if count[key[i]] == 1]
    return {(i, j) for i in alone for j in alone if i < j and key[i][:6] == key[j][:6] and similar(key[i], key[j]) >= 0.9 - 1e-12}


@pytest.mark.parametrize("crowded", [0, 1000])
def test_fuzzy_pairs_in_crowded_blocks(spark, crowded):
    """Blocks whose titles must share a rare group of letters lose no pair."""
    titles = alike_titles()
    items = spark.createDataFrame([(f"K{i}", t, i) for i, t in enumerate(titles)], "key string, title string, scan_order long")
    got = {(r.key_a, r.key_b) for r in dedupe.fuzzy_pairs(items, crowded=crowded).collect()}
    expected = {(f"K{i}", f"K{j}") for i, j in plain_pairs(titles)}
    assert got == expected and len(expected) > 20


def test_bits_of_letter_groups_lose_no_pair(spark):
    """Bits let every pair through that is alike, and tell most others."""
    titles = [*alike_titles(), "the quick brown fox jumps over a lazy dog while it rains", "pack my box with five dozen liquor jugs and zip it up now"]
    t = spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(titles)], "i long, k string, n long").withColumn("bits", dedupe.gram_bits("k"))
    both = t.alias("a").join(t.alias("b"), F.col("a.i") < F.col("b.i"))
    passed = {(r.x, r.y) for r in both.where(dedupe.may_be_alike("a.bits", "b.bits", F.col("a.n"), F.col("b.n"), 0.9)).select(F.col("a.i").alias("x"), F.col("b.i").alias("y")).collect()}
    alike = {(i, j) for i, a in enumerate(titles) for j, b in enumerate(titles) if i < j and similar(a, b) >= 0.9}
    assert alike <= passed and (len(titles) - 2, len(titles) - 1) not in passed


def test_counts_of_letters_tell_tails_apart(spark):
    """Titles with one long beginning and other ends do not come to a distance; those within it do."""
    head = "the than thhasted attionen thesat ed in oran "
    titles = [head + "eandon en blend it ernt scum", head + "ingerou ingerou ingerou in", head + "zuzuzu kklm 0123 wxyz", head + "eandon en blend it ernt scums"]
    t = spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(titles)], "i long, k string, n long").withColumn("bits", dedupe.gram_bits("k"))
    both = t.alias("a").join(t.alias("b"), F.col("a.i") < F.col("b.i"))
    passed = {(r.x, r.y) for r in both.where(dedupe.may_be_alike("a.bits", "b.bits", F.col("a.n"), F.col("b.n"), 0.9)).select(F.col("a.i").alias("x"), F.col("b.i").alias("y")).collect()}
    assert passed == {(0, 3)}


@pytest.mark.parametrize("crowded", [3, 50, 2000])
def test_near_pairs_of_a_block_in_parts(spark, crowded):
    """However a crowded block is cut, each pair is found once, the earlier title first, with its similarity."""
    rng = random.Random(7)
    titles = [f"common beginning {''.join(rng.choice('ab c') for _ in range(rng.randrange(1, 40)))}" for _ in range(120)]
    titles += [t[:-1] + rng.choice("abcd") for t in titles[:60]] + ["other block " + "x" * k for k in range(1, 30)]
    rng.shuffle(titles)
    items = spark.createDataFrame([(f"K{i}", t, i) for i, t in enumerate(titles)], "key string, title string, scan_order long")
    got = [(r.key_a, r.key_b, r.similarity) for r in dedupe.fuzzy_pairs(items, crowded=crowded).collect()]
    key = [" ".join(t.split()) for t in titles]
    assert sorted(got) == sorted((f"K{i}", f"K{j}", round(similar(key[i], key[j]), 6)) for i, j in plain_pairs(titles)) and len(got) > 60


def test_bounded_distances():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    n = np.array([len(t) for t in texts])
    codes = np.frombuffer(b"".join(t.encode().ljust(n.max(), b"\1") for t in texts), np.uint8).reshape(len(texts), -1)
    x, y = (v.ravel() for v in np.indices((len(texts), len(texts))))
    for most in (0, 2, 9, 300):
        got = similarity.bounded_distance(codes[x], n[x], codes[y], n[y], np.full(len(x), most))
        full = np.array([round((1 - similar(texts[i], texts[j])) * max(n[i], n[j])) for i, j in zip(x, y, strict=True)])
        assert (got == np.minimum(full, most + 1)).all()


def test_fuzzy_clusters(spark):
    titles = alike_titles()
    near = plain_pairs(titles)
    seeds, owner = [], {}
    for j in sorted({k for p in near for k in p}):
        mine = [i for i in seeds if (i, j) in near]
        if mine:
            owner[j] = mine[0]
        else:
            seeds.append(j)
    items = spark.createDataFrame([(f"K{i}", t, i) for i, t in enumerate(titles)], "key string, title string, scan_order long")
    got = {(r.seed, r.key) for r in dedupe.fuzzy_clusters(items).collect()}
    assert got == {(f"K{s}", f"K{k}") for k, s in owner.items()} | {(f"K{s}", f"K{s}") for s in owner.values()} and len(got) > 20


@pytest.mark.parametrize("few", [0, 40])
def test_fuzzy_clusters_in_rounds_and_in_order(spark, few):
    """Rounds to the end or pairs read in order once few are left: the same clusters."""
    items = spark.createDataFrame([(f"K{i}", t, i) for i, t in enumerate(alike_titles())], "key string, title string, scan_order long")
    once = sorted((r.seed, r.key) for r in dedupe.fuzzy_clusters(items).collect())
    assert sorted((r.seed, r.key) for r in dedupe.fuzzy_clusters(items, few=few).collect()) == once and len(once) > 20


def test_merge_verdicts(spark):
    rows_ = [("a", "Banda", "", 1), ("a", "Banda, Juan M.", "", 2), ("b", "Scott", "3rd", 3), ("b", "Scott", "4th ed", 4), ("b", "", "", 5), ("c", "An", "1", 6), ("c", "Ann", "", 7), ("c", "Nan", "1", 8), ("d", "X", "2nd", 9), ("d", "X", "2ND", 10)]
    items = spark.createDataFrame([(t, f"K{o}", o, n, e, "book", "2000") for t, n, e, o in rows_], "title string, key string, scan_order long, last_name string, edition string, type string, date string")
    got = {r.k: (r.confident, r.reason) for r in dedupe.group_verdicts(items).collect()}
    assert got == {"a": (True, ""), "b": (False, "different editions"), "c": (False, "different authors"), "d": (True, "")}


def test_duplicate_probe_of_short_titles(spark):
    titles = ["Graph networks", "Hypergraph networks", "graph networks!", "Graph of networks", "It", "Dune", "Dune.", "dunes", "The theory of it all and more", "The Theory of it all and More"]
    items = spark.createDataFrame([(f"K{i}", t, "", i) for i, t in enumerate(titles)], "key string, title string, last_name string, scan_order long")
    got = {r.probe_id: r.key for r in dedupe.duplicate_probe(items, items.select(F.col("scan_order").alias("probe_id"), "title", "last_name")).collect()}
    words = [re.sub("[^a-z0-9]+", " ", t.lower()).strip() for t in titles]
    expected = {}
    for i, t in enumerate(words):
        phrase = " ".join([w for w in t.split(" ") if len(w) > 2][:4])
        hits = [j for j in range(len(titles)) if phrase and phrase in titles[j].lower() and similar(t, words[j]) >= 0.9]
        if hits:
            expected[i] = f"K{hits[0]}"
    assert got == expected


@pytest.mark.parametrize("crowded", [2, 2000])
def test_duplicate_probe_of_crowded_phrases(spark, crowded):
    """Many alike titles of one phrase, however they are cut: the first item of the probe's name, or of any if it has none."""
    rng = random.Random(11)
    titles = [f"{rng.choice(['Licensed under the Apache', 'Café of the great', 'To be'])} version of {''.join(rng.choice('ab ') for _ in range(rng.randrange(1, 8)))} thing" for _ in range(70)]
    names = [rng.choice(["", "Ann", "Bo", None]) for _ in titles]
    items = spark.createDataFrame([(f"K{i:02}", t, n, i if i % 9 else None) for i, (t, n) in enumerate(zip(titles, names, strict=True))], "key string, title string, last_name string, scan_order long")
    probes = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(zip(titles, names, strict=True))], "probe_id long, title string, last_name string")
    got = {r.probe_id: (r.key, r.similarity) for r in dedupe.duplicate_probe(items, probes, crowded=crowded).collect()}
    key = [re.sub("[^a-z0-9]+", " ", t.lower()).strip() for t in titles]
    name = [(n or "").lower() for n in names]
    expected = {}
    for i, t in enumerate(key):
        phrase = " ".join([w for w in t.split(" ") if len(w) > 2][:4])
        hits = [j for j in range(len(key)) if phrase in titles[j].lower() and name[i] in ("", name[j]) and similar(t, key[j]) >= 0.9]
        if hits:
            first = min(hits, key=lambda j: (j % 9 == 0, j))
            expected[i] = (f"K{first:02}", round(similar(t, key[first]), 6))
    assert got == expected and len(expected) > 20


def test_probes_and_items_that_do_not_meet_stay_out_of_the_comparison(spark, monkeypatch):
    """Items whose phrase no probe has are not dealt out."""
    items = spark.createDataFrame([(f"K{i}", f"unrelated words number {i} of a long list here", "", i) for i in range(50)] + [("P", "the quick brown fox jumps over it", "", 99)], "key string, title string, last_name string, scan_order long")
    probes = items.where("key = 'P'").select(F.lit(1).alias("probe_id"), "title", "last_name")
    dealt, real = [], dedupe.first_near
    monkeypatch.setattr(dedupe, "first_near", lambda rows, *a: (dealt.append(rows.count()), real(rows, *a))[1])
    assert [r.key for r in dedupe.duplicate_probe(items, probes).collect()] == ["P"] and dealt == [2]


def test_auto_outline(spark, views):
    """Each document's outline comes from the best evidence, and says what the single steps say."""
    lines = views.pdf_lines.drop("text").join(views.toc_lines.select("doc_id", "ord", "text"), ["doc_id", "ord"])
    links = views.links.where("doc_id % 6 = 0")
    got = rows(QUERIES["outline_auto"](spark, SF))
    source = {}
    for r in got:
        assert source.setdefault(r["doc_id"], r["source"]) == r["source"] and 1 <= r["level"] <= 4
    runs = outline.contents_runs(outline.contents_pages(lines, links))
    printed = {r["doc_id"] for r in rows(outline.printed_contents(runs, lines))}
    linked = {r["doc_id"] for r in rows(runs) if r["doc_id"] % 6 == 0}
    by_link = {d for d, s in source.items() if s == "contents-links"}
    assert by_link and by_link <= linked
    assert {d for d, s in source.items() if s == "contents-printed-numbers"} <= printed - by_link
    assert {s for s in source.values()} == {"contents-links", "contents-printed-numbers", "typography"}


def test_deep_collections(spark):
    from lectern.operators import catalog

    tree = spark.createDataFrame([("K0", None, "top")] + [(f"K{i}", f"K{i - 1}", "n") for i in range(1, 40)] + [("A", "B", "a"), ("B", "A", "b")], "key string, parent_key string, name string")
    assert {r.key: r.depth for r in catalog.descendants(tree, "K0").collect()} == {f"K{i}": i for i in range(40)}
    assert {r.key: r.depth for r in catalog.descendants(tree, "A").collect()} == {"A": 0, "B": 1}


def test_languages(spark):
    from lectern.operators import scan_prep

    asked = spark.createDataFrame([(1, "", "Espanol (Chile)"), (2, "", "es-ES"), (3, "fra", "es"), (4, "", "Klingon"), (5, "", None), (6, None, "spanish"), (7, "", "Français")], "id int, requested string, language string")
    assert {r.id: r.pack for r in scan_prep.pick_language(asked).collect()} == {1: "spa", 2: "spa", 3: "fra", 4: "eng", 5: "eng", 6: "spa", 7: "fra"}


def test_attach_refuses(spark):
    from lectern.operators import edits

    items = spark.createDataFrame([("A", "book"), ("N", "note")], "key string, type string")
    have = spark.createDataFrame([("X", "A")], "key string, parent_key string")
    kinds = "key string, parent_key string, file string, url string, link boolean"
    good = edits.attach(have, items, spark.createDataFrame([("Y", "A", "f.pdf", None, None), ("Z", "A", "", "http://x", True)], kinds))
    assert sorted((r.key, r["mode"], r.source) for r in good.collect() if r["mode"]) == [("Y", "file", "f.pdf"), ("Z", "link", "http://x")]
    for bad in (("Y", "A", "f", "u", False), ("Y", "A", None, "", False), ("Y", "N", "f", None, False), ("Y", "Q", "f", None, False)):
        with pytest.raises(Exception, match="exactly one|not a regular|no item"):
            edits.attach(have, items, spark.createDataFrame([bad], kinds)).collect()


def test_outline_set_to_nothing_is_refused(spark):
    kinds = "doc_id long, entries array<struct<level:int,title:string,page:int>>"
    with pytest.raises(Exception, match="no outline entries"):
        outline.set_outlines(spark.createDataFrame([], kinds), spark.createDataFrame([(1, [])], kinds)).collect()


def test_wrapped_printed_entries(spark):
    """An entry that begins in lower case takes the lines above it, up to where it began; not across a gap or a page."""
    text = ["Contents", "Of the nation", "and its demo-", "cratization ..... 7", "Second ..... 9", "far above", "alone ..... 11", "Third ..... 12", "lower start", "fourth ..... 14"]
    y = [10, 30, 44, 58, 72, 86, 200, 214, 228, 242]
    lines = spark.createDataFrame([(1, 1, k, t, 70.0 + k, 200.0, float(v), v + 10.0) for k, (t, v) in enumerate(zip(text, y, strict=True))], "doc_id long, page int, ord long, text string, x0 double, x1 double, y double, y1 double")
    runs = spark.createDataFrame([(1, 1, 1, True)], "doc_id long, first int, last int, titled boolean")
    got = [(r.title, r.printed, r.x0) for r in outline.printed_contents(runs, lines).orderBy("ord").collect()]
    assert got == [("Of the nation and its democratization", 7, 71.0), ("Second", 9, 74.0), ("alone", 11, 76.0), ("Third", 12, 77.0), ("lower start fourth", 14, 78.0)]


def shuffled(df):
    """The plan's text, from which exchanges and scans can be counted."""
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_titles_of_long_lines_are_needles(spark):
    """a beginning is folded alone only where the whole title gives the same; short ones are no needles."""
    texts = ["Ünï-Code " * 30, "." * 90 + "après la fin de l'ouvrage, une très longue suite de mots", "a. b", "- " * 100, "x" * 41, "word " * 8, None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, title string")
    old = F.regexp_replace(F.regexp_replace(F.lower(F.col("t")), "[^a-z0-9 ]", " "), " +", " ")
    from lectern.functions import text as T

    src, dst = T.accent_map()
    plain = df.withColumn("t", F.translate(F.regexp_replace("title", r"\p{Mn}", ""), src, dst)).select("k", F.substring(F.trim(old), 1, outline.NEEDLE).alias("n"), outline.needle(F.col("title")).alias("got"))
    for r in plain.collect():
        assert r.got == (r.n if r.n is not None and len(r.n) >= outline.LEAST_NEEDLE else None)


def test_page_texts_are_folded_only_where_asked(spark):
    """pages that no entry can be on do not meet; the texts are not folded a second time in a filter."""
    entries = spark.createDataFrame([(1, 1, "Chapter number 7", 7, False, 7, "none")], "doc_id long, ord long, title string, printed int, roman boolean, page int, confidence string")
    pages = spark.createDataFrame([(1, p, f"chapter number {p} begins") for p in range(1, 30)], "doc_id long, page int, text string")
    found = outline.verify_pages(entries, pages)
    assert found.collect()[0].confidence == "verified" and "LeftSemi" in shuffled(found)
    assert not [x for x in shuffled(found).splitlines() if "Filter" in x and "regexp_replace" in x]


def test_texts_of_linked_lines_are_shuffled_once(spark, views):
    """F8: no join has a line's text on either side."""
    plan = shuffled(outline.linked_contents(views.links, views.toc_lines))
    assert plan.count("Join ") == 1 and "LeftSemi" not in plan


def test_printed_contents_parse_lines_once(spark, views):
    """what is returned is read from what was written, not parsed anew for each use."""
    lines = views.column_lines
    plan = shuffled(outline.printed_contents(outline.contents_runs(outline.contents_pages(lines)), lines))
    assert "rlike" not in plan.lower() and "Generate" not in plan


def test_contents_pages_shuffle_beginnings(spark, views):
    """pages are judged once; what is returned judges none again."""
    assert "collect_list(struct(ord" not in shuffled(outline.contents_pages(views.column_lines)) and "regexp_replace" not in shuffled(outline.contents_pages(views.column_lines))


def test_lines_end_like_entries(spark):
    """the quick look at a line's end lets every entry through."""
    texts = ["A title ... 12", "A title\u00a012 \t", "A title .\t\u00a0xii\n", "Title .. XIV\u00a0 ", "no number", "A title12", "A title..999", "A t ..... mmmdccclxxxviii", "A title ... " + "i" * 15]
    got = [r.e for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", outline.contents_line("t").alias("e")).orderBy("k").collect()]
    assert [e and e.printed for e in got] == [12, 12, 12, 14, None, None, 999, None, 15]


def test_outline_reads_only_documents_without_contents_for_headings(spark, views):
    """what comes back reads written tables; no line is scored or joined again."""
    assert "Generate" not in shuffled(QUERIES["outline_auto"](spark, SF))


def test_attachments_without_parents_are_not_joined(spark):
    """null keys, which a join would have in one task, stay out of it; all rows are there."""
    from lectern.operators import storage

    a = spark.createDataFrame([("a", "p", "t", 1), ("b", None, "t", 2), ("c", "q", "t", 3)], "key string, parent_key string, content_type string, size long")
    p = spark.createDataFrame([("p", "Title", "1999-01-01")], "key string, title string, date string")
    out = storage.inventory(a, p)
    assert sorted((r.key, r.parent_key, r.title, r.year, r.size) for r in out.collect()) == [("a", "p", "Title", "1999", 1), ("b", None, "", "", 2), ("c", "q", "", "", 3)]
    assert "isnotnull(parent_key" in shuffled(out) and "Union" in shuffled(out)


def test_page_gutter_is_the_gutter_of_the_smoothed_profile(spark):
    """the cut of a page's array equals the one by windows over its columns, and no column is a row."""
    from lectern.operators import scan_prep

    rng = random.Random(4)
    pages = [(k, [rng.choice([0.0, 0.1, 0.3, rng.random()]) for _ in range(rng.choice([0, 3, 7, 8, 9, 40, 41]))]) for k in range(80)] + [(99, [0.5] * 40)]
    df = spark.createDataFrame(pages, "doc_id long, profile array<double>")
    for window in (1, 3, 5, 9):
        by_rows = {r.doc_id: r.cut for r in scan_prep.gutter(scan_prep.smooth(df.select("doc_id", F.posexplode("profile").alias("i", "ink")), window)).collect()}
        got = {r.doc_id: r.cut for r in df.select("doc_id", scan_prep.page_gutter(F.col("profile"), window).alias("cut")).collect()}
        assert got == {k: by_rows.get(k) for k, _ in pages} and len(by_rows) > 20
    rasters = spark.createDataFrame([], "doc_id long, page int, width int, height int, samples binary")
    assert "Generate" not in shuffled(scan_prep.measured(rasters)) and "Join" not in shuffled(scan_prep.choose_gutter(scan_prep.measured(rasters)))
