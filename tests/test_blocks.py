"""Files of many blocks, read by many tasks, against the one-task read."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from queuesight.sources.blocks import pieces
from queuesight.sources.readers import read_tickets


@pytest.fixture
def blocks_of(spark):
    """Sets how many bytes a block has, so that small files have many."""
    settings = {"spark.sql.files.maxPartitionBytes": None, "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in settings}

    def set_size(size):
        for key, value in settings.items():
            spark.conf.set(key, value or str(size))

    yield set_size
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def write_csv(path, rows, header, end="\n", separator=","):
    with open(path, "w", newline="", encoding="utf-8") as f:
        writer = csv.writer(f, lineterminator=end, delimiter=separator)
        writer.writerow(header)
        writer.writerows(rows)


def cell(rng, some):
    return "".join(rng.choice(some) for _ in range(rng.randint(0, 8)))


SOME = ["a", "b", '"', '""', ",", "\t", "\n", "\n\n", "\r\n", " ", "é", "x" * 20, "NULL"]


@pytest.mark.parametrize(("kind", "end", "size"), [("csv", "\n", 600), ("tsv", "\n", 900), ("csv", "\r\n", 700)])
def test_csv_of_many_blocks(spark, tmp_path, blocks_of, kind, end, size):
    rng = random.Random(size)
    some = SOME if end == "\n" else [s for s in SOME if s not in ("\n", "\n\n")]
    for name in "ab":
        rows = [[f"{name}{i}", cell(rng, some), cell(rng, some)] for i in range(150)]
        write_csv(tmp_path / f"{name}.{kind}", rows, ["id", "customer message", "x.y"], end, "\t" if kind == "tsv" else ",")
    path = f"{tmp_path}/*.{kind}"
    whole = read_tickets(spark, path, format=kind)
    blocks_of(size)
    got = read_tickets(spark, path, format=kind, parallel=True, position="at")
    files = pieces(spark, path, "\n").groupBy("file").agg(F.countDistinct("block").alias("n")).collect()
    assert len(files) == 2 and all(r["n"] > 5 for r in files)  # blocks, and so tasks, a file
    assert got.columns == [*whole.columns, "at"] and rows_of(got.drop("at")) == rows_of(whole)
    assert [r["id"] for r in got.orderBy("at").collect()] == [f"{n}{i}" for n in "ab" for i in range(150)]


def test_csv_cells_longer_than_blocks(spark, tmp_path, blocks_of):
    rows = [["1", 'quoted ""\n' * 400], ["2", "line\n" * 300 + '"'], ["3", ""], ["4", "end\n"]]
    write_csv(tmp_path / "a.csv", rows, ["id", "body"])
    whole = rows_of(read_tickets(spark, f"{tmp_path}/a.csv"))
    blocks_of(256)
    assert rows_of(read_tickets(spark, f"{tmp_path}/a.csv", parallel=True)) == whole and len(whole) == 4


def test_csv_odds_and_ends(spark, tmp_path, blocks_of):
    texts = {
        "no final line feed": 'id,t\n1,"a\nb"\n2,c',
        "empty lines": 'id,t\n\n1,"a\n\nb"\n\n\n2,\n',
        "short and long rows": "id,t,u\n1\n2,b,c,d\n",
        "byte order mark": '﻿id,t\n1,"x"\n',
        "header only": "id,t\n",
        "quoted header": '"id","a ""b"""\n1,2\n',
    }
    for name, text in texts.items():
        path = tmp_path / f"{name.replace(' ', '-')}.csv"
        path.write_text(text, encoding="utf-8")
        whole = read_tickets(spark, str(path))
        got = read_tickets(spark, str(path), parallel=True)
        assert got.columns == whole.columns and rows_of(got) == rows_of(whole), name
    blocks_of(9)
    path = str(tmp_path / "empty-lines.csv")
    assert rows_of(read_tickets(spark, path, parallel=True)) == [("1", "a\n\nb"), ("2", None)]


def test_csv_schema_and_misplaced_quotes(spark, tmp_path):
    write_csv(tmp_path / "a.csv", [["1", "2.5"], ["x", "1"]], ["id", "score"])
    got = read_tickets(spark, f"{tmp_path}/a.csv", "id int, score double", parallel=True)
    assert got.dtypes == [("id", "int"), ("score", "double")] and rows_of(got) == [(1, 2.5), (None, 1.0)]
    for bad in ('id,t\n1,a"b\n2,c"d\n', 'id,t\n1,"a"b\n', 'id,t\n1,"open\n'):
        (tmp_path / "bad.csv").write_text(bad)
        with pytest.raises(ValueError, match="bad.csv"):
            read_tickets(spark, f"{tmp_path}/bad.csv", parallel=True)
    with pytest.raises(ValueError, match="parallel"):
        read_tickets(spark, f"{tmp_path}/a.csv", infer=True, parallel=True)


JSON_SOME = ["a", '"', "\\", "{", "}", "[", "]", "},{", "\n", " ", "é", '"}', '\\"', "x" * 20]


@pytest.mark.parametrize("style", [{}, {"indent": 2}, {"ensure_ascii": False, "separators": (",", ":")}])
def test_json_list_of_many_blocks(spark, tmp_path, blocks_of, style):
    rng = random.Random(len(style))
    for name in "ab":
        rows = [{"id": f"{name}{i}", "t": cell(rng, JSON_SOME), "deep": {"l": [[], [cell(rng, JSON_SOME)]], "m": {}}} for i in range(120)]
        (tmp_path / f"{name}.json").write_text(json.dumps(rows, **style), encoding="utf-8")
    path = f"{tmp_path}/*.json"
    whole = spark.read.json(path, multiLine=True)
    blocks_of(800)
    assert pieces(spark, path, "}").select("file", "block").distinct().count() > 10
    got = read_tickets(spark, path, format="json", parallel=True)
    assert got.schema == whole.schema and rows_of(got) == rows_of(whole)


def test_json_that_is_no_list_of_rows(spark, tmp_path):
    path = tmp_path / "bad.json"
    for bad in ('[{"a":1},{"a":2}', '[{"a":1} {"a":2}]', '{"a":1}', "[1,2]", '[{"a":1},]', 'x[{"a":1}]', '[{"a":1}]]', '[{"a":1}] x', '[{"a":tru}]', "", '[{"a":"}]'):
        path.write_text(bad)
        with pytest.raises(ValueError, match="bad.json"):
            read_tickets(spark, str(path), parallel=True)
    path.write_text(" [ ]\n")
    assert read_tickets(spark, str(path), parallel=True).collect() == []
    path.write_text('﻿ [ {"a": 1} ,\n{"a": 2}\n] ')
    assert rows_of(read_tickets(spark, str(path), parallel=True)) == [(1,), (2,)]
