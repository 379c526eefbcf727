"""Arrays and objects of objects, cut by ranges of bytes."""

import json
import random

import pytest

from reelmill.sources import files, records


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows_of(n, seed=1):
    """Objects with brackets, quotation marks and backslashes in their texts, and some of many ranges."""
    rng = random.Random(seed)
    bits = ['"', "\\", "{", "}", "[", "]", ",", ":", "\n", "é", "}{", '\\"', "word ", " ", ""]
    return [
        {"id": i, "review": "".join(rng.choices(bits, k=rng.choice([0, 3, 40, 900 if i % 17 == 0 else 9]))),
         "extra": rng.choice([None, {"a": [{"}": "]"}, []]}, [], {}, "x"])}
        for i in range(n)
    ]


def lines_of(spark, path, layout, **how):
    return sorted(r["value"] for r in records.record_lines(spark, [str(path)], layout, **how).collect())


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("ascii_only", [True, False])
def test_ranges_give_what_one_reader_gives(spark, tmp_path, small_ranges, indent, ascii_only):
    rows = rows_of(150)
    keys = [f'k{i} }} "quoted" {{' for i in range(len(rows))]
    path = {k: tmp_path / f"{k}.json" for k in ("array", "dict")}
    path["array"].write_text(json.dumps(rows, indent=indent, ensure_ascii=ascii_only), encoding="utf-8")
    path["dict"].write_text("﻿" + json.dumps(dict(zip(keys, rows)), indent=indent, ensure_ascii=ascii_only) + "\n", encoding="utf-8")
    for layout, file in path.items():
        fragments = records._fragments(spark, [str(file)])
        assert fragments.select("start").distinct().count() >= 10  # read by many tasks
        got = sorted((json.loads(v) for v in lines_of(spark, file, layout)), key=lambda r: r["id"])
        assert got == rows


def test_shuffled_starts_give_the_same(spark, tmp_path, small_ranges, monkeypatch):
    path = tmp_path / "a.json"
    path.write_text(json.dumps(rows_of(60)))
    want = lines_of(spark, path, "array")
    monkeypatch.setattr(records, "MEASURED_BROADCAST_BYTES", -1)
    assert len(want) == 60 and lines_of(spark, path, "array") == want


def test_a_record_longer_than_many_ranges(spark, tmp_path, small_ranges):
    rows = [{"id": 0, "a": [{"b": i, "c": "}" * 5} for i in range(900)]}, {"id": 1}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    assert [json.loads(v) for v in lines_of(spark, tmp_path / "a.json", "array")] == rows


def test_several_files_empty_ones_and_repeated_records(spark, tmp_path):
    for i, text in enumerate(["[]", " [ ] \n", json.dumps([{"a": 1}] * 3), json.dumps([{"a": 2}])]):
        (tmp_path / f"part-{i}.json").write_text(text)
    assert lines_of(spark, tmp_path, "array") == ['{"a": 1}'] * 3 + ['{"a": 2}']
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "d.json").write_text("{}")
    assert lines_of(spark, tmp_path / "none", "dict") == []


@pytest.mark.parametrize("layout, text", [
    ("array", '[{"a": 1}, {"a": 2}'), ("array", '[{"a": 1}, {"a": 2'), ("array", '[{"a": 1}'), ("array", '[{"a": 1}, 2]'),
    ("array", '[{"a": 1}]x'), ("array", '[{"a": 1} {"a": 2}]'), ("array", '[1, {"a": 1}]'), ("array", '[{"a": 1}]\n[{"a": 2}]'),
    ("dict", '{"k": {"a": 1}'), ("dict", '{"k": {"a": 1}, "l": {"a": 2}\n'), ("dict", '{"k": {"a": 1}, "l": 2}'),
    ("dict", '{"a": {"b": 1}, "c": {}}\n{"a": {"b": 2}, "c": {}}'),
])
def test_broken_files_raise(spark, tmp_path, layout, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="malformed record"):
        lines_of(spark, tmp_path / "a.json", layout)
    assert set(lines_of(spark, tmp_path / "a.json", layout, on_broken="skip")) <= {'{"a": 1}', '{"a": 2}', '{"b": 1}', '{"b": 2}', "{}"}


def test_layout_is_read_on_beyond_the_head(spark, tmp_path):
    row = {"helpful": {"yes": 1}, "votes": {"no": 2}, "review": "x" * (2 * files.HEAD)}
    (tmp_path / "part-1.json").write_text("\n".join([json.dumps(row)] * 3))
    assert files.read_reviews(spark, str(tmp_path)).count() == 3
    (tmp_path / "d").mkdir()
    content = {str(i): {"review": "y" * 100, "rating": i} for i in range(2000)}
    (tmp_path / "d" / "part-1.json").write_text(json.dumps(content))
    assert files.read_reviews(spark, str(tmp_path / "d")).count() == 2000
