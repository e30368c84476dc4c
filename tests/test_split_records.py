"""Files cut at every place: CSV against Spark's own reader of whole files, JSON against the json module."""

import json
import random

import pyarrow as pa
import pytest

from tests.conftest import plan_of
from voxtally.schemas import SURVEY_FIELDS
from voxtally.sources import files, split_records


@pytest.fixture
def small_splits(spark):
    """Splits of some bytes, so that most records lie in several."""
    def of(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield of
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def made_cell(rng):
    kind = rng.random()
    if kind < 0.2:
        return rng.choice(["plain", "5\" pipe", "", "é ü 中", "a'b"])
    inner = "".join(rng.choice(["x", " ", ",", "\n", "\r\n", '""', "word", "é", "\n\n", "'"]) for _ in range(rng.randrange(9)))
    return f'"{inner}"'


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_like_whole_files(spark, tmp_path, small_splits, seed, end):
    rng = random.Random(seed)
    rows = [["id", "response", "lang", "extra"]] + [
        [str(i).zfill(3), *(made_cell(rng) for _ in range(3))] for i in range(60)
    ]
    text = end.join(",".join(r) for r in rows) + (end if seed % 2 else "")
    text = text.replace(f"{end}010,", f"{end}{end}010,", 1)  # an empty line between records
    path = tmp_path / "in.csv"
    path.write_bytes(text.encode())
    whole = spark.read.csv(str(path), header=True, multiLine=True, escape='"', lineSep=end if end == "\n" else None)
    expected = [(r["response_id"], r["text"], r["language"]) for r in files.rename_columns(whole).collect()]
    small_splits(rng.choice([40, 90, 300]))
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 2
    got = files.read_csv(spark, str(path), positions=True).orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(60))
    assert [(r["response_id"], r["text"], r["language"]) for r in got] == expected


def test_csv_of_several_files(spark, tmp_path, small_splits):
    for name, rows in (("b", ['3,"x\ny"', "4,z"]), ("a", ['1,"p, ""q"""', "2,"])):
        (tmp_path / f"{name}.csv").write_text("id,text\n" + "\n".join(rows) + "\n", "utf-8")
    small_splits(5)
    got = files.read_csv(spark, str(tmp_path), positions=True).orderBy("pos").collect()
    assert [(r["response_id"], r["text"]) for r in got] == [("1", 'p, "q"'), ("2", None), ("3", "x\ny"), ("4", "z")]
    assert got[0].asDict().keys() == {"pos", *SURVEY_FIELDS}


def test_csv_whose_last_cell_stays_open(spark, tmp_path, small_splits):
    (tmp_path / "in.csv").write_text('id,text\n1,a\n2,"never\nclosed, \n', "utf-8")
    small_splits(6)
    got = {r["response_id"]: r["text"] for r in files.read_csv(spark, str(tmp_path)).collect()}
    assert got.keys() == {"1", "2"} and got["2"].startswith('never\nclosed, ') or got["2"].startswith('"never\nclosed')


def test_csv_header_only(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,text\n", "utf-8")
    assert files.read_csv(spark, str(tmp_path), positions=True).collect() == []


def made_value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind < 3:
        return "".join(rng.choice(['"', "\\", "}", "{", "]", "[", ",", "x", "é", "\n", " ", "\\}"]) for _ in range(rng.randrange(7)))
    if kind == 3:
        return rng.choice([None, True, 3, -1.5e3])
    if kind == 4:
        return [made_value(rng, depth + 1) for _ in range(rng.randrange(3))]
    return {f"k{i}": made_value(rng, depth + 1) for i in range(rng.randrange(3))}


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("indent", [None, 2])
def test_json_arrays_like_the_json_module(spark, tmp_path, small_splits, seed, indent):
    rng = random.Random(seed)
    rows = [
        {"id": f"r{i}", "text": "".join(rng.choice(['"', "\\", "}", "{", "a", ",", "\n", "中"]) for _ in range(9)),
         "lang": "en", "x": made_value(rng)}
        for i in range(40)
    ]
    path = tmp_path / "in.json"
    path.write_text(json.dumps(rows, indent=indent, ensure_ascii=bool(seed % 2)) + "\n" * (seed % 3), "utf-8")
    small_splits(rng.choice([50, 90, 300]))
    assert spark.read.text(str(path), lineSep="}").rdd.getNumPartitions() > 2
    found = split_records.records(spark, str(path), split_records.JsonChunks)
    cut = split_records.numbered(found).orderBy("pos").collect()
    assert [(r["pos"], json.loads(r["record"])) for r in cut] == list(enumerate(rows))
    got = files.read_json(spark, str(path), positions=True).orderBy("pos").collect()
    assert [(r["response_id"], r["text"], r["language"]) for r in got] == [(r["id"], r["text"], "en") for r in rows]


def test_json_of_both_kinds_by_default(spark, tmp_path):
    rows = [{"id": "a", "text": "one"}, {"id": "b", "text": "two"}]
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)), "utf-8")
    (tmp_path / "array.json").write_text("  \n" + json.dumps(rows, indent=4), "utf-8")
    for name in ("lines", "array"):
        got = files.read_json(spark, str(tmp_path / f"{name}.json"), positions=True).orderBy("pos").collect()
        assert [(r["pos"], r["response_id"], r["text"]) for r in got] == [(0, "a", "one"), (1, "b", "two")]


@pytest.mark.parametrize("text, records", [
    ('[{"id": "a"}, 5, "x", {"id": "b"}]', ["a", None, None, "b"]),  # elements that are no records
    ('[{"id": "a"}, {"id": "b"', ["a", None]),  # the file ends in a record
    ('[{"id": "a"} {"id" "b"}, {"id": "c"}]', ["a", None, "c"]),  # no comma, no colon
    ("[]", []), ("[ ]\n", []), ('[{}]', [None]),
])
def test_odd_json(spark, tmp_path, small_splits, text, records):
    (tmp_path / "in.json").write_text(text, "utf-8")
    small_splits(4)
    got = files.read_json(spark, str(tmp_path / "in.json"), positions=True).orderBy("pos").collect()
    assert [r["response_id"] for r in got] == records


def test_whole_records_are_not_shuffled(spark, tmp_path, small_splits):
    path = tmp_path / "in.json"
    path.write_text(json.dumps([{"id": str(i)} for i in range(500)]), "utf-8")
    small_splits(400)
    plan = plan_of(files.read_json(spark, str(path)))
    assert "Union" in plan
    first = plan.split("Union")[1].split("\n")[1:6]
    assert not any("Exchange" in line for line in first)


def test_a_worker_takes_a_batch_in_parts():
    """However large a batch is, a limited part of it becomes Python's strings at a time."""
    texts = ["x" * 5000] * 2000 + ["y"] * 3000
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["value"])
    parts = list(split_records._parts(iter([batch, batch.slice(0, 0), batch.slice(10, 3)])))
    assert [v for p in parts for v in p.column("value").to_pylist()] == texts + texts[10:13]
    assert max(map(len, parts)) <= split_records.LINES
    assert max(sum(map(len, p.column("value").to_pylist())) for p in parts) <= 4 * split_records.PART_BYTES
