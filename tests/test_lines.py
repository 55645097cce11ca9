"""Splittable text: line numbers over byte ranges, first lines, and readers on files cut into many ranges."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridclime.sources import lines, sinks, tables, text_files


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_numbers_of_a_file_that_many_tasks_read(spark, tmp_path, small_ranges):
    texts = {
        "a b%.csv": [f"line {n} " + "x" * (n % 40) if n % 7 else "" for n in range(6000)],
        "b.csv": ["  "] * 400 + ["only"] + [" "] * 3000,
        "c.csv": ["1"],
        "d.csv": [],
        "e.csv": ["y" * 30_000, "z", "w" * 20_000],
    }
    for name, rows in texts.items():
        (tmp_path / name).write_bytes("\r\n".join(rows).encode())
    found = lines.numbered_lines(spark, f"{tmp_path}/*.csv")
    assert found.rdd.getNumPartitions() > 10
    got = {}
    for r in found.withColumn("path", lines.decoded_path(F.col("file"))).collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.number, r.value, r.n_lines))
    want = {}
    for name, rows in texts.items():
        full = [r for r in rows if r.strip()]
        if full:
            want[name] = [(k + 1, r, len(full)) for k, r in enumerate(full)]
    assert {k: sorted(v) for k, v in got.items()} == want


def test_numbering_fails_when_the_ranges_have_changed(spark, tmp_path, small_ranges):
    (tmp_path / "a.txt").write_text("\n".join(f"line {n}" for n in range(5000)))
    found = lines.numbered_lines(spark, f"{tmp_path}/a.txt")
    assert found.count() == 5000
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5k")
    with pytest.raises(Exception, match="cut otherwise"):
        lines.numbered_lines(spark, f"{tmp_path}/a.txt").unionByName(found).agg(F.sum("number")).collect()


def test_first_lines_read_only_the_start(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"f{k}.txt").write_text("\n".join(f"{k} {n}" for n in range(k * 30_000)))
    heads = {r.file.rsplit("/", 1)[1]: r.head for r in lines.first_lines(spark, str(tmp_path), 3).collect()}
    assert heads == {f"f{k}.txt": [f"{k} {n}" for n in range(3)] for k in range(1, 5)}


def test_series_longer_than_a_range(spark, tmp_path, small_ranges):
    (tmp_path / "S1" / "tmintmax").mkdir(parents=True)
    values = [n / 8 for n in range(9000)]
    text = [""] * 5 + ["remark"] * 36 + [f"{v},x" for v in values] + ["NaN,x", "", ""]
    (tmp_path / "S1" / "tmintmax" / "CA_N_tmax.csv").write_text("\n".join(text))
    got = text_files.read_series(spark, f"{tmp_path}/*/tmintmax/*tmax*", 41, "Tmax").orderBy("position").collect()
    assert [r.Tmax for r in got] == values[:-1] + [values[-2]]
    assert [r.position for r in got] == list(range(1, 9001)) and got[-1].Date == dt.date(2006, 1, 1) + dt.timedelta(days=8999)
    # a series of one row keeps it, one of none has no rows
    (tmp_path / "S1" / "tmintmax" / "ONE_tmax.csv").write_text("\n".join(["r"] * 41 + ["3", "NaN"]))
    (tmp_path / "S1" / "tmintmax" / "NO_tmax.csv").write_text("\n".join(["r"] * 41))
    short = text_files.read_series(spark, f"{tmp_path}/*/tmintmax/*O*tmax*", 41, "Tmax").collect()
    assert [(r.load_zone, r.Tmax, r.position) for r in short] == [("ONE", 3.0, 1)]


def test_wide_block_longer_than_a_range(spark, tmp_path, small_ranges):
    for name, names in (("s1_k.csv", ["Year", "Timestep", "A B", '"C,1"']), ("s2_k.csv", ["Year", "Timestep", "D"])):
        rows = [",".join(map(str, [2000 + n // 12, n % 12 + 1, *[n + 0.5 * j for j in range(len(names) - 2)]])) for n in range(4000)]
        (tmp_path / name).write_text("\n".join(["p", "", "p", "p", "p", ",".join(names), "", *rows]))
    found = text_files.read_wide_export(spark, f"{tmp_path}/*.csv")
    got = {(r.scenario, r.object_name): (r.n, r.s) for r in found.groupBy("scenario", "object_name").agg(F.count("GWh").alias("n"), F.sum("GWh").alias("s")).collect()}
    total = 4000 * 3999 / 2
    assert got == {("s1", "A B"): (4000, total), ("s1", "C 1"): (4000, total + 2000), ("s2", "D"): (4000, total)}


def test_cells(spark):
    text = 'a,"b, c", d ,"say ""x"", y",,"'
    row = spark.range(1).select(lines.cells(F.lit(text)).alias("c"), lines.cells(F.lit("1;2"), ";").alias("d")).first()
    assert row.c[:5] == ["a", "b, c", " d ", 'say "x", y', ""] and row.d == ["1", "2"]


def test_csv_larger_than_a_range_is_read_once_by_header(spark, tmp_path, small_ranges):
    for k, header in enumerate((["a", "b", "x"], ["x", "b", "a"], ["b"])):
        rows = [",".join(str(n) if c == "a" else f"t{n}" if c == "b" else "NA" for c in header) for n in range(3000)]
        (tmp_path / f"{k} [x].csv").write_text("﻿" * (k == 1) + "\n".join([",".join(header), *rows]))
    found = tables.read_columns(spark, f"{tmp_path}/*.csv", {"a": "int", "b": "string", "x": "double"})
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 1
    got = sorted(((r.path[-9], r.a, r.b, r.x) for r in found.collect()), key=repr)
    assert got == sorted(((str(k), None if k == 2 else n, f"t{n}", None) for k in range(3) for n in range(3000)), key=repr)


def test_a_write_that_stops_before_its_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    from gridclime.sources import versions

    path = f"file://{tmp_path}/t"
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "id int, v string")
    sinks.write_keyed(df, path, "id")

    def stopped(*_):
        raise RuntimeError("executor and driver lost")

    with monkeypatch.context() as m:
        m.setattr(versions, "_commit", stopped)
        with pytest.raises(RuntimeError):
            sinks.write_keyed(spark.createDataFrame([(1, "c"), (3, "d")], "id int, v string"), path, "id", overwrite=True)
    old = sorted(map(tuple, sinks.read_version(spark, path).collect()), key=repr)
    assert old == sorted([("a", 1), ("b", 2), ("n", None)], key=repr) and sinks.versions(spark, path) == [1]
    for _ in range(2):  # run again, and once more after its end
        now = sinks.write_keyed(spark.createDataFrame([(1, "c"), (3, "d")], "id int, v string"), path, "id", overwrite=True)
    new = sorted([("b", 2), ("c", 1), ("d", 3), ("n", None)], key=repr)
    assert sorted(map(tuple, now.collect()), key=repr) == new and now.schema["id"].dataType.simpleString() == "int"
    assert sorted(map(tuple, sinks.read_version(spark, path, 1).collect()), key=repr) == old
    with pytest.raises(sinks.KeyExistsError):
        sinks.write_keyed(df.where("id is null"), path, "id")
    gone = sinks.vacuum(spark, path, keep=1)
    assert len(gone) == 2 and sinks.versions(spark, path) == [3]
    assert sorted(map(tuple, sinks.read_version(spark, path).collect()), key=repr) == new


def test_two_writers_and_a_manifest_that_does_not_end(spark, tmp_path, monkeypatch):
    from gridclime.sources import versions

    path = f"file://{tmp_path}/t"
    sinks.write_keyed(spark.createDataFrame([("a/b=1", 1)], "k string, n int"), path, "k")
    real, other = versions.Folder.create, []

    def late(self, name, text):
        if not other:  # another writer commits first
            other.append(name)
            sinks.write_keyed(spark.createDataFrame([("c", 3)], "k string, n int"), path, "k")
        return real(self, name, text)

    monkeypatch.setattr(versions.Folder, "create", late)
    got = sinks.write_keyed(spark.createDataFrame([("b", 2)], "k string, n int"), path, "k").collect()
    assert sorted((r.k, r.n) for r in got) == [("a/b=1", 1), ("b", 2), ("c", 3)]
    (tmp_path / "t" / "manifest" / "00000004.json").write_text('{"schema": ')
    assert sinks.read_version(spark, path).count() == 3
    sinks.write_keyed(spark.createDataFrame([("d", 4)], "k string, n int"), path, "k")
    assert sinks.versions(spark, path) == [1, 2, 3, 5] and sinks.read_version(spark, path).count() == 4


def test_rebuild_and_empty_tables(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        sinks.read_version(spark, path)
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    assert sinks.rebuild(df, path).collect() == df.collect()
    assert sinks.rebuild(df.where("false"), path, ["v"]).collect() == []
    assert sinks.read_version(spark, path, 1).collect() == df.collect()
    with pytest.raises(ValueError):
        sinks.rebuild(df.withColumnRenamed("v", "Write"), path)


def test_files_get_their_names_and_order(spark, tmp_path):
    rows = [(f"d{n % 3}/x {n % 3}.txt", n, f"l{n}") for n in range(60)]
    sinks.write_files(spark.createDataFrame(rows, "file string, number int, line string"), f"file://{tmp_path}/o")
    for k in range(3):
        assert (tmp_path / "o" / f"d{k}" / f"x {k}.txt").read_text().split() == [f"l{n}" for n in range(k, 60, 3)]
