"""Files that people write: what is read, and which line is refused."""

import json

import pytest

from lectern.sources import library


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_edits(spark, tmp_path):
    path = write(tmp_path / "e.jsonl", """# a comment

{"key": "A", "set": {"title": "T"}, "addTags": ["x"], "removeTags": ["y"], "addToCollection": "C", "trash": true}
{"key": "B"}
""")
    got = sorted(str(tuple(r)) for r in library.read_edits(spark, path).collect())
    assert got == sorted(str(x) for x in [
        (3, "A", "title", "T", None, False, None, False), (3, "A", None, None, "x", False, None, False), (3, "A", None, None, "y", True, None, False),
        (3, "A", None, None, None, False, "C", False), (3, "A", None, None, None, False, None, True),
    ])


@pytest.mark.parametrize(("text", "line"), [('{"key": "A"}\n{"set": {}}\n', 2), ("\n\nnot json\n", 3)])
def test_bad_edits_name_their_line(spark, tmp_path, text, line):
    with pytest.raises(library.BadLineError, match=f"line {line}"):
        library.read_edits(spark, write(tmp_path / "e.jsonl", text)).collect()


def test_merge_plan(spark, tmp_path):
    path = write(tmp_path / "p.jsonl", '{"master": "A", "others": ["B", "C"]}\n')
    assert sorted(tuple(r) for r in library.read_merge_plan(spark, path).collect()) == [("A", "B"), ("A", "C")]
    with pytest.raises(library.BadLineError):
        library.read_merge_plan(spark, write(tmp_path / "q.jsonl", '{"master": "A", "others": []}\n')).collect()


def test_tag_map(spark, tmp_path):
    path = write(tmp_path / "t.csv", " a , b ,c\nx,y\n,z\n")
    assert sorted(tuple(r) for r in library.read_tag_map(spark, path).collect()) == [("a", "b"), ("x", "y")]


def test_exports_and_log(spark, tmp_path):
    rows = spark.createDataFrame([("A", "t", "2020-01-01")], "key string, title string, day string")
    library.write_export_json(rows, str(tmp_path / "j"))
    assert [json.loads(x.value) for x in spark.read.text(str(tmp_path / "j")).collect()] == [{"key": "A", "title": "t", "day": "2020-01-01"}]
    for _ in range(2):
        library.append_log(rows, str(tmp_path / "log"), "day")
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2 and (tmp_path / "log" / "day=2020-01-01").is_dir()
