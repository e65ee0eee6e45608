"""Lines numbered over splits and files, pages, parts of a log, marks of finished work, rasters, counts beside rows."""

import json
import math
import os
import random
from functools import reduce
from operator import add

import pytest
from pyspark.sql import functions as F

from lectern.operators import analyze, catalog, edits, enrich, outline, scan_prep, tags
from lectern.plans.adapters import Views
from lectern.sources import library, ordered, pages
from lectern.streaming import audit, markers


def jobs(spark, f):
    """What ``f`` gives, and how many jobs it ran."""
    group = f"g{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    out = f()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext._jsc.clearJobGroup()
    return out, n


def test_lines_of_several_files_and_splits(spark, tmp_path):
    text = {"b.jsonl": [f"line {k} " + "x" * (k % 50) for k in range(2000)], "a.jsonl": ["# note", "", "one", "\ttwo\r", "  ", "three"], "empty.jsonl": []}
    for name, lines in text.items():
        (tmp_path / name).write_bytes("\n".join(lines).encode() + (b"\n" if name == "b.jsonl" else b""))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        got = library.numbered_lines(spark, str(tmp_path)).orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    mine = [(os.path.basename(r.file), r.line_no, r.seq, r.text) for r in got]
    assert mine[:3] == [("a.jsonl", 3, 3, "one"), ("a.jsonl", 4, 4, "\ttwo"), ("a.jsonl", 6, 6, "three")]
    assert mine[3:] == [("b.jsonl", k + 1, k + 7, t) for k, t in enumerate(text["b.jsonl"])]


def test_last_set_of_the_last_file_wins(spark, tmp_path):
    (tmp_path / "1.jsonl").write_text('{"key": "A", "set": {"title": "first"}}\n')
    (tmp_path / "2.jsonl").write_text('\n{"key": "A", "set": {"title": "second"}}\n')
    rows = library.read_edits(spark, str(tmp_path))
    assert sorted((r.seq, r.value) for r in rows.collect()) == [(1, "first"), (3, "second")]
    assert [r.value for r in edits.last_sets(rows).collect()] == ["second"]
    (tmp_path / "3.jsonl").write_text('{"key": "B"}\n{"set": {}}\n')
    with pytest.raises(library.BadLineError, match=r"3\.jsonl, line 2"):
        library.read_edits(spark, str(tmp_path))


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(40), k, rng.randrange(1, 9)) for k in range(500)]
    df = spark.createDataFrame(rows, "a int, b int, size int").repartition(7)
    total, expected = 0, {}
    for a, b, size in sorted(rows):
        expected[a, b] = total
        total += size
    assert {(r.a, r.b): r.before for r in ordered.running(df, ["a", "b"], F.col("size")).collect()} == expected
    assert ordered.running(df.limit(0), ["a", "b"]).collect() == []


def test_only_the_pages_asked_for_are_read(spark, tmp_path):
    path = str(tmp_path / "p")
    pages.write_pages(spark.createDataFrame([(f"k{k:03}",) for k in range(103)], "key string").repartition(5), ["key"], path, 10)
    got = pages.read_pages(spark, path, 9, 30)
    assert [(r.key, r.place, r.total, r.page) for r in got.orderBy("place").collect()] == [(f"k{k:03}", k, 103, k // 10) for k in range(90, 103)]
    plan = pages.read_pages(spark, path, 3, 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(page" in plan


def test_counts_come_with_the_rows(spark):
    df = spark.createDataFrame([(f"k{k}", k) for k in range(200)], "key string, n int")
    (rows, total), n = jobs(spark, lambda: catalog.page_of(df, [F.desc("n")], catalog.LIST_LIMIT))
    assert n == 1 and total == 200 and [r.n for r in rows.orderBy(F.desc("n")).collect()] == list(range(199, 99, -1))
    assert catalog.page_of(df.limit(0), [F.col("n")])[1] == 0
    assert catalog.notice(25, 40) == "showing 25 of 40" and catalog.notice(3, 3) == ""


def test_reasons_are_counted_as_they_are_written(spark, sf):
    v = Views(spark, sf)
    found, counts = enrich.pick_counted(v.items, v.candidates, "abstract", exact=False)
    assert counts == {r.reason: r.n for r in found.groupBy("reason").agg(F.count("*").alias("n")).collect()} and sum(counts.values()) > 10
    assert sorted(map(tuple, enrich.rejections(found).collect())) == sorted((k, n) for k, n in counts.items() if k != "ok")
    assert sorted(map(str, found.collect())) == sorted(map(str, enrich.pick(v.items, v.candidates, "abstract", exact=False).collect()))


def test_audit_records(spark):
    calls = [("2024-01-01T00:00:00", "a", "  \n first line\nsecond", True, None, 3), ("2024-01-01T00:00:01", "b", None, False, "e" * 300, None), ("2024-01-01T00:00:02", "c", "x" * 500, None, None, 0)]
    got = audit.records(spark.createDataFrame(calls, "ts string, label string, code string, ok boolean, error string, would_write int")).orderBy("ts").collect()
    assert [(r.codeBytes, r.codeHead, r.ok, r.error, r.dryRunWrites) for r in got] == [(21, "first line", True, None, 3), (0, "", False, "e" * 200, None), (500, "x" * 120, False, "", 0)]
    assert got[1].codeSHA256 == "e3b0c44298fc1c14"


def test_audit_log_is_cut_by_size(spark, tmp_path):
    path = str(tmp_path / "log")
    made = lambda a, b: audit.records(spark.createDataFrame([(f"2024-01-01T00:{k // 60:02}:{k % 60:02}", k, "call", "c" * (k % 70), k % 5 > 0, "bad") for k in range(a, b)], "ts string, id int, label string, code string, ok boolean, error string").withColumn("would_write", F.lit(None).cast("int")).repartition(4), ["id"])
    assert audit.append_audit(made(0, 300), path, ["ts", "id"], 4096) and audit.append_audit(made(300, 420), path, ["ts", "id"], 4096)
    parts = {}
    for r in spark.read.text(path).withColumn("file", F.input_file_name()).withColumn("k", F.monotonically_increasing_id()).orderBy("part", "file", "k").collect():
        parts.setdefault(r.part, []).append(r.value)
    assert sorted(parts) == list(range(len(parts))) and len(parts) > 10
    widest = max(len(x) + 1 for own in parts.values() for x in own)
    sizes = [sum(len(x) + 1 for x in parts[k]) for k in sorted(parts)]
    assert all(4096 - widest < s < 4096 + widest for s in sizes[:-1])
    told = [json.loads(x)["ts"] for k in sorted(parts) for x in parts[k]]
    assert len(told) == 420 and sorted(told) == sorted(f"2024-01-01T00:{k // 60:02}:{k % 60:02}" for k in range(420))
    first = [json.loads(x)["ts"] for k in sorted(parts)[:3] for x in parts[k]]
    assert first == sorted(first)
    (tmp_path / "file").write_text("in the way")
    assert audit.append_audit(made(0, 3), str(tmp_path / "file" / "log"), ["ts", "id"]) is False


def test_work_is_done_once_over_stops(spark, tmp_path):
    source, done, stop = tmp_path / "in", str(tmp_path / "marks"), {"at": 1}
    worked = []

    def work(todo):
        keys = [r.key for r in todo.collect()]
        if len(worked) == stop["at"]:
            stop["at"] = -1
            raise RuntimeError("stopped")
        worked.append(keys)
        return todo.select("key", F.when(F.col("key").endswith("0"), "no gain").otherwise("attached").alias("status"))

    def run(checkpoint="c", force=False):
        stream = spark.readStream.schema("key string").option("maxFilesPerTrigger", "1").json(str(source))
        markers.work_once(stream, done, str(tmp_path / checkpoint), work, force).awaitTermination(120)

    for name, keys in (("a", range(0, 12)), ("b", range(6, 20)), ("c", range(18, 25))):
        spark.createDataFrame([(f"k{k}",) for k in keys for _ in range(2)], "key string").coalesce(1).write.json(str(source / name))
    for name in ("a", "b", "c"):  # one folder's files lie in the source itself
        for f in (source / name).glob("part*"):
            f.rename(source / f"{name}-{f.name}")
    with pytest.raises(Exception, match="stopped"):
        run()
    run()
    flat = [k for keys in worked for k in keys]
    assert sorted(flat) == sorted(f"k{k}" for k in range(25))  # none twice, though keys come back and a batch was stopped
    assert {r.key: r.status for r in markers.marks(spark, done).collect()} == {f"k{k}": "no gain" if k % 10 == 0 else "attached" for k in range(25)}
    run("other")  # a new query over the same files
    assert sum(map(len, worked)) == 25
    run("third", force=True)
    assert sum(map(len, worked)) == 25 + 12 + 14 + 7
    targets = spark.createDataFrame([("k0",), ("k77",)], "key string")
    assert [r.key for r in markers.without_done(targets, markers.marks(spark, done)).collect()] == ["k77"]
    assert markers.without_done(targets, markers.marks(spark, done), force=True).count() == 2
    assert markers.marks(spark, str(tmp_path / "none")).count() == 0


def plain_ink(width, height, data):
    rows = [data[y * width : (y + 1) * width] for y in range(0, height, 2)]
    rows = [r for r in rows if len(r) == width]
    level = (min(data) + max(data)) // 2 if data else 128
    return [sum(r[x] < level for r in rows) / len(rows) for x in range(width)] if rows else []


def test_ink_of_rasters(spark):
    rng = random.Random(6)
    made = [(1, k, w, h, bytes(rng.randrange(30, 220) if rng.random() < 0.5 else 210 for _ in range(n))) for k, (w, h, n) in enumerate([(10, 8, 80), (10, 8, 57), (3, 50, 150), (7, 1, 7), (5, 4, 3)])]
    rows = [*made, (2, 0, 0, 5, b"abc"), (2, 1, 4, 4, None), (2, 2, 4, 4, b"")]
    got = {(r.doc_id, r.page): list(r.profile) for r in scan_prep.column_ink(spark.createDataFrame(rows, "doc_id long, page int, width int, height int, samples binary")).collect()}
    for d, p, w, h, data in rows:
        assert got[d, p] == pytest.approx(plain_ink(w, h, data or b"") if w else [])


def test_gutter_from_pixels(spark):
    """Two inked halves with a white gap right of the middle: the page is cut there."""
    width, height = 200, 60
    rng = random.Random(1)
    page = lambda gap: bytes(255 if not (15 < x < gap - 6 or gap + 6 < x < 185) or rng.random() < 0.4 else 20 for _ in range(height) for x in range(width))
    rows = [(1, k, width, height, page(104)) for k in range(1, 5)] + [(1, 5, width, height, bytes([255]) * width * height)]
    samples = scan_prep.measured(spark.createDataFrame(rows, "doc_id long, page int, width int, height int, samples binary"))
    got = {r.page: (r.cut, r.ink) for r in samples.collect()}
    assert got[5] == (None, 0.0) and all(abs(got[k][0] - 0.52) < 0.02 and got[k][1] > 0.2 for k in range(1, 5))
    facts = scan_prep.choose_gutter(samples).withColumns({"width": F.lit(840.0), "height": F.lit(600.0), "processed": F.lit(False)})
    assert [(r.decision, math.isclose(r.cut, 0.52, abs_tol=0.02)) for r in scan_prep.decide(facts).collect()] == [("split", True)]


def test_linked_lines_meet_by_bands(spark):
    rng = random.Random(9)
    box = lambda: (x := rng.uniform(0, 300), x + rng.uniform(1, 200), y := rng.uniform(0, 600), y + rng.choice([0.0, 8.0, 12.0, 90.0]))
    lines = [(d, p, k, f"t{k}", *box()) for d in (1, 2) for p in (1, 2) for k in range(25)]
    links = [(d, p, k, k + 3, *box()) for d in (1, 2) for p in (1, 2) for k in range(15)]
    got = outline.link_titles(spark.createDataFrame(links, "doc_id long, page int, link_ord long, target int, x0 double, x1 double, y double, y1 double"), spark.createDataFrame(lines, "doc_id long, page int, ord long, text string, x0 double, x1 double, y double, y1 double"))
    expected = {}
    for d, p, k, _, a0, a1, b0, b1 in lines:
        for dd, pp, _, target, c0, c1, e0, e1 in links:
            share = max(min(a1, c1) - max(a0, c0), 0) * max(min(b1, e1) - max(b0, e0), 0) / max((a1 - a0) * (b1 - b0), 1e-9)
            if (d, p) == (dd, pp) and share > 0.3:
                expected.setdefault((d, p, k), target)
    assert {(r.doc_id, r.page, r.ord): r.target for r in got.collect()} == expected and len(expected) > 5


def test_long_outlines(spark):
    """An outline of 200,000 entries takes time in proportion."""
    rows = spark.range(200_000).select(F.lit(1).alias("doc_id"), F.col("id").alias("ord"), (1 + F.col("id") % 7).cast("int").alias("level"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("title"), F.col("id").cast("int").alias("page"))
    got = outline.normalize_rows(rows, F.lit(1000), 5)
    assert got.count() == 200_000 and got.agg(F.max("level"), F.max("page"), F.max("i")).first() == (5, 1000, 199_999)
    rough = spark.createDataFrame([(1, 0, 3, " a  b ", 0), (1, 1, 5, "c", None), (1, 2, 5, "c", 1), (1, 3, None, "", 2), (1, 4, 1, None, 2), (1, 5, 0, "d", 9)], "doc_id int, ord long, level int, title string, page int")
    assert [(r.i, r.level, r.title, r.page) for r in outline.normalize_rows(rough).orderBy("i").collect()] == [(0, 1, "a b", 1), (1, 2, "c", 1), (2, 1, "d", 9)]


def test_small_operators(spark, tmp_path):
    tree = spark.createDataFrame([("C1", None, "top")], "key string, parent_key string, name string")
    made = edits.create_collection(tree, "C2", "below", "C1")
    assert {(r.key, r.parent_key, r.name) for r in made.collect()} == {("C1", None, "top"), ("C2", "C1", "below")}
    with pytest.raises(LookupError):
        edits.create_collection(tree, "C3", "x", "C9")
    notes = spark.createDataFrame([("A", "<p>one</p>")], "item_key string, html string")
    new = spark.createDataFrame([("A", "one"), ("A", "two"), ("B", "one")], "item_key string, text string")
    assert sorted(map(tuple, edits.add_notes(notes, new, if_not_exists=True).collect())) == [("A", "<p>one</p>"), ("A", "<p>two</p>"), ("B", "<p>one</p>")]
    assert edits.add_notes(notes, new).count() == 4
    items = spark.createDataFrame([("A", "t")], "key string, title string")
    log = spark.createDataFrame([("A", "was", "op"), ("Z", "gone", "op"), ("Z", "other", "op2")], "key string, title string, op_id string")
    assert [r.key for r in edits.gone_since(items, log, "op").collect()] == ["Z"]
    assert [tuple(r) for r in edits.undo(items, log, "op").collect()] == [("A", "was")]
    some = spark.createDataFrame([(1, "A", "C1"), (2, "A", "C9"), (3, "Q", "C1"), (4, "A", None)], "seq int, key string, collection string")
    held = spark.createDataFrame([("A", "C5")], "item_key string, collection_key string")
    assert sorted(map(tuple, edits.apply_collections(held, some, tree, items).collect())) == [("A", "C1"), ("A", "C5")]
    assert sorted(r.key for r in catalog.unresolved(items, ["A", "B", "B", "C"]).collect()) == ["B", "C"]
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"rules": [{"match": "^a", "tags": ["x"]}], "containers": ["Inbox"]}))
    assert tags.load_rules(str(path)) == ([{"match": "^a", "tags": ["x"]}], ["Inbox"])
    for bad in ('{"rules": 3}', '[1]', '{"rules": [{"match": "(", "tags": []}]}'):
        path.write_text(bad)
        with pytest.raises(ValueError, match="rule|object"):
            tags.load_rules(str(path))
    reports = spark.createDataFrame([("ok",), ("ok",), ("failed",)], "status string")
    assert {r.status: r.n for r in analyze.status_counts(reports).collect()} == {"ok": 2, "failed": 1}
    firsts = catalog.first_by(spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "g int, v string"), "g", F.col("v"))
    assert sorted(map(tuple, firsts.collect())) == [(1, "a"), (2, "c")]
    flat = spark.createDataFrame([("K", None, "book", "T, \"q\"", "2001", "2001", ["A B", "C"], "V", "d", "u", ["x", "y"], "abs")], "key string, citekey string, type string, title string, date string, year string, creators array<string>, venue string, doi string, url string, tags array<string>, abstract string")
    library.write_export_csv(flat, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True, escape="\\")
    assert back.columns == analyze.EXPORT_COLUMNS and (back.first().creators, back.first().tags, back.first().citekey) == ("A B; C", "x; y", None)


def test_scan_from_pixels(spark, sf):
    """The registered query against loops over each page's bytes."""
    from statistics import median

    from lectern.plans.catalogue import QUERIES

    def measured(data):
        profile = plain_ink(40, 32, data)
        if not profile:
            return None, 0.0
        near = [profile[max(i - 1, 0) : i + 2] for i in range(40)]
        own = [reduce(add, x) / len(x) for x in near]  # added one by one: sum() rounds differently, and equal columns tie
        middle = range(math.floor(40 * (0.5 - 0.18)), math.ceil(40 * (0.5 + 0.18)))
        low, high = min(own[i] for i in middle), max(own[i] for i in middle)
        best, start = (0, 0), None
        for i in middle if high - low >= 0.01 else ():
            start = (i if start is None else start) if own[i] <= low + 0.25 * (high - low) else None
            if start is not None and i - start + 1 > best[0]:
                best = (i - start + 1, start)
        return round((best[1] + best[0] / 2) / 40, 6) if best[0] else None, sum(profile) / 40

    expected = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").collect():
        data = r.text.encode()
        pages = [measured(data[k : k + 1280]) for k in range(0, max(len(data), 1), 1280)]
        cuts = [c for c, ink in pages if c is not None and ink >= 0.03]
        middle = median(cuts) if cuts else None
        share = round(sum(abs(c - middle) <= 0.02 + 1e-12 for c in cuts) / len(cuts), 6) if cuts else 0.0
        sure = share >= 0.6
        expected[r.doc_id] = (share, "split" if sure else "no-gutter", round(middle, 6) if sure else None)
    got = {r.doc_id: (r.confidence, r.decision, r.cut) for r in QUERIES["scan_from_pixels"](spark, sf).collect()}
    wrong = {k: (got.get(k), v) for k, v in expected.items() if got.get(k) != v}
    assert not wrong and len(got) == len(expected) and {d for _, d, _ in got.values()} == {"split", "no-gutter"}
