"""Rules of the library operators on small tables."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import analyze, catalog, dedupe, edits, enrich, outline, scan_prep, storage, tags
from lectern.sources import library


def row(title="T", year="", author="", edition="", kind=""):
    return (title, year, author, edition, kind)


GROUPS = [
    ([row(year="1991", author="Adams"), row(year="2013", author="Brown")], "different authors"),
    ([row(year="2012", author="Cole", edition="Third"), row(year="2017", author="Cole", edition="4th")], "different editions"),
    ([row(year="1982", author="Dee"), row(year="2023", author="Dee")], "years 1982-2023"),
    ([row(year="2016", author="Ñúñez"), row(year="2016", author="Nunez")], ""),
    ([row(year="2010", author="Fox"), row(year="2011", author="Fox")], ""),
    ([row(year="2020", author="Gil"), row(year="2020", author="Gil, Ana M.")], ""),
    ([row(year="1937", author="Hay", kind="thesis"), row(year="1938", author="Hay", kind="journalArticle")], "different item types (journalArticle, thesis)"),
    ([row(year="2020", author="Ito", kind="webpage"), row(year="2020", author="Ito", kind="blogPost")], ""),
    ([row(), row(year="2016", author="Jay")], ""),
]


@pytest.mark.parametrize(("group", "reason"), GROUPS)
def test_merge_confidence(spark, group, reason):
    df = spark.createDataFrame([(group,)], "g array<struct<title:string,year:string,first_author:string,edition:string,type:string>>")
    got = df.select(dedupe.merge_confidence(F.col("g")).alias("x")).first().x
    assert (got.confident, got.reason) == (reason == "", reason)


def test_fuzzy_clusters_are_greedy(spark):
    titles = ["abcdef one two three four", "abcdef one two three fou", "abcdef one two three fo", "abcdef one two three f", "zzz other", "abcdef one two three four five six"]
    items = spark.createDataFrame([(f"K{i}", t, i) for i, t in enumerate(titles)], "key string, title string, scan_order long")

    def similarity(a, b):
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(prev[j] + 1, now[-1] + 1, prev[j - 1] + (x != y)))
            prev = now
        return 1 - prev[-1] / max(len(a), len(b))

    for threshold in (0.9, 0.95):
        used, expected = set(), set()
        for i, a in enumerate(titles):
            if i in used:
                continue
            mine = [j for j in range(i + 1, len(titles)) if j not in used and titles[j][:6] == a[:6] and similarity(a, titles[j]) >= threshold]
            if mine:
                used |= {i, *mine}
                expected |= {(f"K{i}", f"K{j}") for j in [i, *mine]}
        got = {(r.seed, r.key) for r in dedupe.fuzzy_clusters(items, threshold).collect()}
        assert got == expected


ATT = "key string, parent_key string, content_type string, size long, annotations int, n_collections int, n_tags int, deleted boolean, linked boolean, has_file boolean, done boolean"


def att(key="A", parent=None, kind="application/pdf", size=30 << 20, notes=0, colls=0, ntags=0, deleted=False, linked=False, has=True, done=False):
    return (key, parent, kind, size, notes, colls, ntags, deleted, linked, has, done)


def test_orphans(spark):
    rows = [att("A"), att("B", parent="P"), att("C", colls=1), att("D", ntags=1), att("E", notes=1), att("F", deleted=True)]
    df = spark.createDataFrame(rows, ATT)
    assert [r.key for r in df.where(storage.is_disposable_orphan()).collect()] == ["A"]


def test_shrink_targets(spark):
    rows = [att("A"), att("B", size=10), att("C", done=True), att("D", linked=True), att("E", deleted=True), att("F", has=False), att("G", parent="P", done=True), att("H", kind="text/html")]
    df = spark.createDataFrame(rows, ATT)
    keys = lambda d: [r.key for r in d.collect()]
    assert keys(storage.shrink_targets(df)) == ["A"]
    assert keys(storage.shrink_targets(df, force=True)) == ["A", "C", "G"]
    asked = spark.createDataFrame([("B",), ("P",), ("X",)], "key string")
    assert keys(storage.shrink_targets(df, keys=asked)) == ["G", "B"]
    assert keys(storage.unmatched_keys(df, asked)) == ["X"]


@pytest.mark.parametrize(("before", "after", "a", "b", "reason"), [(100, 0, 1, 1, "empty output"), (100, 50, None, 1, "unreadable page count"), (100, 50, 2, 1, "page count differs"), (100, 81, 1, 1, "no meaningful gain"), (100, 80, 1, 1, "ok"), (0, 5, 1, 1, "no meaningful gain")])
def test_shrink_verdict(spark, before, after, a, b, reason):
    df = spark.createDataFrame([(before, after, a, b)], "x long, y long, a int, b int")
    assert df.select(storage.shrink_verdict(F.col("x"), F.col("y"), F.col("a"), F.col("b")).alias("v")).first().v.reason == reason


RULES = [{"match": "plague|epidemic", "tags": ["#plague"]}, {"match": "medicion", "tags": ["#medición"]}, {"match": "state of the art", "tags": ["~theory"]}]


@pytest.mark.parametrize(
    ("path", "containers", "expected"),
    [
        ("Work / Papers / Plague in towns", ["Work", "Papers"], {"#plague"}),
        ("X / PLAGUE", [], {"#plague"}),
        ("@Medición / Other things", ["@Medición"], set()),
        ("@Medición / Old / State of the art / Medición", ["@Medición"], {"#medición", "~theory"}),
        ("@Medición", ["@Medición"], {"#medición"}),
        ("Plague / State of the art", [], {"#plague", "~theory"}),
    ],
)
def test_tags_of_paths(spark, path, containers, expected):
    df = spark.createDataFrame([("I", path)], "item_key string, path string")
    assert {r.tag for r in tags.tags_of_paths(df, RULES, containers).collect()} == expected


def test_bad_rule_is_reported():
    with pytest.raises(ValueError, match="rule 0"):
        tags.check_rules([{"match": "[unclosed", "tags": ["#x"]}])


def test_normalization_plan(spark):
    df = spark.createDataFrame([("AI",), ("ai",), ("Ai ",), ("solo",)], "tag string")
    assert {r.tag: r.target for r in tags.normalization_plan(df).collect()} == {"ai": "AI", "Ai ": "AI"}
    given = spark.createDataFrame([("ai", "robots"), ("solo", "")], "tag string, target string")
    assert {r.tag: r.target for r in tags.normalization_plan(df, given).collect()} == {"ai": "robots", "Ai ": "AI"}


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ("Introduction .......... 15", ("Introduction", 15, False)), ("1.1 Origins....17", ("1.1 Origins", 17, False)), ("Preface······ix", ("Preface", 9, True)), ("Bibliography   201", ("Bibliography", 201, False)),
        ("Chapter 1. Start .... 15", ("Chapter 1. Start", 15, False)), ("Preface . . . 12", ("Preface", 12, False)), ("Capítulo 1", None), ("Chapter 12", None), ("Tabla 12", None), ("Figure 3", None),
        ("Tablas de datos .... 88", ("Tablas de datos", 88, False)), ("Index — mix", None), ("No page here", None), ("", None), ("   ", None), ("... 42", None),
    ],
)
def test_contents_line(spark, line, expected):
    got = spark.createDataFrame([(line,)], "c string").select(outline.contents_line("c").alias("x")).first().x
    assert (tuple(got) if got else None) == expected


def test_contents_line_looks_at_the_end(spark):
    """Separators of lines inside a title are characters like others (as in SQL); short titles, long runs and a number that is all there is."""
    cases = {"Part\u2028two .... 12": ("Part\u2028two", 12, False), "ab. 7": ("ab", 7, False), "a. 7": None, "End. xii": ("End", 12, True), "End xii": None, "x" * 5000 + "." * 5000 + "9": ("x" * 5000, 9, False), "12345": None, " . 12": None, "On 12345": None, "A–B – 3": ("A–B", 3, False)}
    df = spark.createDataFrame([(c,) for c in cases], "c string").withColumn("x", outline.contents_line("c"))
    assert {r.c: tuple(r.x) if r.x else None for r in df.collect()} == cases


def test_surname_is_what_sql_says(spark):
    """White space other than spaces at the end of a name stays, and leaves no last word."""
    names = {("Ann", "Lee"): "Lee", ("Ann", "Lee\n"): "", ("Ann", ""): "Ann", ("Ann\t", ""): "", ("Ann", "de\x0b"): "de\x0b", ("", " Lee "): "Lee", (None, None): ""}
    items = spark.createDataFrame([(a, b, "T", "", "") for a, b in names], "first_name string, last_name string, title string, doi string, date string").withColumn("key", F.to_json(F.struct("first_name", "last_name")))
    got = {r.key: r.surname for r in enrich.item_facts(items).collect()}
    assert list(got.values()) == list(names.values())


@pytest.mark.parametrize(("indents", "expected"), [([72.0, 90.0, 90.5, 72.0, 108.0], [1, 2, 2, 1, 3]), ([72.0, 73.5, 72.4], [1, 1, 1]), ([10.0 + 20 * k for k in range(8)], [1, 2, 3, 4, 5, 6, 6, 6]), ([], [])])
def test_indent_levels(spark, indents, expected):
    df = spark.createDataFrame([(indents,)], "a array<double>")
    assert df.select(outline.indent_levels(F.col("a")).alias("x")).first().x == expected


def test_outline_normalize(spark):
    entries = [(3, " A  b ", 0), (9, "C", 5), (9, "C", 5), (1, "", 4), (2, "D", 99), (1, "E", 2)]
    df = spark.createDataFrame([(entries,)], "e array<struct<level:int,title:string,page:int>>")
    got = df.select(outline.normalize(F.col("e"), F.lit(10), 4).alias("x")).first().x
    assert [tuple(r) for r in got] == [(1, "A b", 1), (2, "C", 5), (2, "D", 10), (1, "E", 2)]
    again = spark.createDataFrame([(got,)], "e array<struct<level:int,title:string,page:int>>").select(outline.normalize(F.col("e"), F.lit(10), 4).alias("x"), outline.backwards(F.col("e")).alias("b")).first()
    assert again.x == got and again.b == [3]


def test_outline_text(spark):
    text = "A\t1\n  B b  5\n# no\n\n\tC\t7"
    got = spark.createDataFrame([(text,)], "t string").select(outline.parse(F.col("t")).alias("x")).first().x
    assert [tuple(r) for r in got] == [(1, "A", 1), (2, "B b", 5), (2, "C", 7)]
    with pytest.raises(Exception, match="outline line 2"):
        spark.createDataFrame([("A\t1\nno page",)], "t string").select(outline.parse(F.col("t"))).collect()
    loaded = spark.createDataFrame([('{"toc":[{"level":2,"title":"X","physicalPage":4}]}',), ('[{"title":"Y","page":3}]',), ("Z\t9",)], "t string").select(outline.load(F.col("t")).alias("x")).collect()
    assert [[tuple(e) for e in r.x] for r in loaded] == [[(2, "X", 4)], [(1, "Y", 3)], [(1, "Z", 9)]]


def test_resolve_pages(spark):
    e = spark.createDataFrame([(1, 0, 3, True), (1, 1, 1, False), (1, 2, 9, False), (1, 3, 900, False)], "doc_id long, ord long, printed int, roman boolean")
    labels = spark.createDataFrame([(1, "iii", 5)], "doc_id long, label string, page int")
    folio = spark.createDataFrame([(1, "d", 1, 13)], "doc_id long, series string, n int, page int")
    count = spark.createDataFrame([(1, 50)], "doc_id long, page_count int")
    got = {r.ord: (r.page, r.confidence) for r in outline.resolve_pages(e, labels, folio, count).collect()}
    assert got == {0: (5, "labels"), 1: (13, "folio"), 2: (21, "voted"), 3: (50, "voted")}
    got = {r.ord: (r.page, r.confidence) for r in outline.resolve_pages(e, labels, folio, count, offset=2).collect()}
    assert got[2] == (11, "offset")


@pytest.mark.parametrize(("spec", "expected"), [("1,4-6", [1, 4, 5, 6]), ("6-4", [4, 5, 6]), ("9-20", [9, 10]), ("", []), ("0-2,2", [1, 2]), ("30", [])])
def test_page_set(spark, spec, expected):
    assert spark.createDataFrame([(spec,)], "s string").select(scan_prep.page_set(F.col("s"), F.lit(10)).alias("x")).first().x == expected


def test_page_set_rejects(spark):
    with pytest.raises(Exception, match="bad page range"):
        spark.createDataFrame([("1,x",)], "s string").select(scan_prep.page_set(F.col("s"), F.lit(10))).collect()


def test_gutter(spark):
    flat = [(1, i, 0.5) for i in range(200)]
    cut = [(2, i, 0.0 if 95 <= i < 105 else 0.5) for i in range(200)]
    got = {r.doc_id: (r.start, r.length, r.cut) for r in scan_prep.gutter(spark.createDataFrame(flat + cut, "doc_id int, i int, ink double")).collect()}
    assert got == {2: (95, 10, 0.5)}


def test_sample_pages(spark):
    got = spark.createDataFrame([(3,), (100,)], "n int").select(scan_prep.sample_pages(F.col("n"), 5).alias("x")).collect()
    assert [r.x for r in got] == [[0, 1, 2], [10, 26, 42, 58, 74]]


def test_verdict(spark):
    facts = [(0.99, 2010, "Roe", 2011, ["Jane Roe"], "ok"), (0.9, 2010, "Roe", 2010, ["Roe"], "title"), (0.95, None, "", 2010, ["Roe"], "title"), (0.95, 2010, "Roe", 2015, ["Roe"], "year"), (0.95, 2010, "Roe", 2010, ["Doe"], "author"), (0.99, None, "", None, [], "ok")]
    df = spark.createDataFrame(facts, "s double, iy int, sn string, y int, a array<string>, e string")
    for r in df.select(enrich.verdict(F.col("s"), F.col("iy"), F.col("sn"), F.col("y"), F.col("a")).alias("v"), "e").collect():
        assert r.v == r.e


def test_decode(spark):
    a = spark.createDataFrame([('{"DOI":"10.1/A","title":["T"],"issued":{"date-parts":[[2011,2]]},"author":[{"family":"Roe"},{}],"abstract":"<p>Abstract: x</p>"}',)], "json string")
    b = spark.createDataFrame([('{"doi":"https://doi.org/10.1/b","title":"U","publication_year":2012,"authorships":[{"author":{"display_name":"J Roe"}}],"abstract_inverted_index":{"b":[1],"a":[0,2]}}',)], "json string")
    assert tuple(enrich.decode_a(a).first()) == ("10.1/a", "T", 2011, ["Roe"], "x")
    assert tuple(enrich.decode_b(b).first()) == ("10.1/b", "U", 2012, ["J Roe"], "a b a")


def test_edits_and_undo(spark, tmp_path):
    items = spark.createDataFrame([("A", "t", "d"), ("B", "u", "")], "key string, title string, date string")
    f = tmp_path / "edits.jsonl"
    f.write_text('# comment\n{"key":"A","set":{"title":"x"},"addTags":["n"]}\n\n{"key":"A","set":{"title":"y"},"removeTags":["n"]}\n{"key":"Z","trash":true}\n')
    rows = library.read_edits(spark, str(f))
    after = edits.apply_sets(items, rows, ["title", "date"])
    assert {r.key: r.title for r in after.collect()} == {"A": "y", "B": "u"}
    assert [(r.key, r.n) for r in edits.unmatched(items, rows).collect()] == [("Z", 1)]
    own = spark.createDataFrame([("A", "n"), ("B", "m")], "item_key string, tag string")
    assert {tuple(r) for r in edits.apply_tags(own, rows, items).collect()} == {("B", "m")}
    log = edits.snapshot(items, rows, "o")
    assert sorted(map(tuple, edits.undo(after, log, "o").collect())) == sorted(map(tuple, items.collect()))
    f.write_text('{"key":"A"}\n{"nokey":1}\n')
    with pytest.raises(library.BadLineError, match="line 2"):
        library.read_edits(spark, str(f))


def test_catalog_errors(spark):
    a = spark.createDataFrame([att("A", parent="P"), att("B", parent="P"), att("C", parent="Q"), att("D", parent="R", has=False)], ATT)
    assert catalog.the_pdf(a, "Q") == "C"
    for key, error in (("P", catalog.AmbiguousError), ("X", catalog.NotFoundError), ("R", FileNotFoundError)):
        with pytest.raises(error):
            catalog.the_pdf(a, key)
    with pytest.raises(catalog.NotFoundError):
        catalog.resolve_collection(spark.createDataFrame([("K", "N")], "key string, name string"), "none")


def test_first_combined_creator(spark):
    c = spark.createDataFrame([("I", 0, "Solo"), ("I", 1, "A and B"), ("I", 2, "C; D")], "item_key string, ord int, name string")
    assert [tuple(r) for r in analyze.lint_combined_creators(c).collect()] == [("I", "A and B")]
