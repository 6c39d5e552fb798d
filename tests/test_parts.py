"""Part files of an interrupted job: torn, half-written and foreign files, and versions of a table."""

import os

import pytest

from textloom.sources import parts

HEADER, SCHEMA = "id,name,score", "id long, name string, score double"


def put(folder, name, data, changed):
    path = folder / name
    path.write_bytes(data)
    os.utime(path, (changed, changed))


@pytest.fixture
def folder(tmp_path):
    put(tmp_path, "a.csv", b"id,name,score\n1,x,0.5\n2,y,12.34\n", 1_700_000_000)
    put(tmp_path, "b.csv", b"id,name,score\r\n3,\"u, v\",1\r\n4,z,12.3", 1_700_000_100)  # torn in the last value
    put(tmp_path, "c.csv", b"id,name,score\n5,w\n6,q,7,8\nx,r,1\n7,,2\n1,late,9\n\n8,s,3\n", 1_700_000_200)
    put(tmp_path, "d.csv", b"id,na", 1_700_000_300)
    put(tmp_path, "e.csv", b"", 1_700_000_400)
    put(tmp_path, "f.csv", b"name,id,score\np,9,1\n", 1_700_000_500)
    put(tmp_path, "g.csv", b"id,name,score\n10,k,1\n10,k,1", 1_700_000_600)  # the torn line equals a whole one
    put(tmp_path, "h.csv", b"id,name,score\n", 1_700_000_700)
    return tmp_path


def test_faults_of_files(spark, folder):
    got = {r["file"].rsplit("/", 1)[1]: tuple(r)[1:] for r in parts.faults(parts.read_parts(spark, f"{folder}/*.csv", SCHEMA, HEADER)).collect()}
    assert got == {"a.csv": (2, 0, 0, 0), "b.csv": (1, 1, 0, 0), "c.csv": (3, 0, 3, 0), "d.csv": (0, 1, 0, 0), "f.csv": (0, 0, 0, 2), "g.csv": (1, 1, 0, 0)}


def test_whole_rows_are_kept(spark, folder):
    done = spark.createDataFrame([(2, "old", 1.0)], SCHEMA)
    found = parts.read_parts(spark, f"{folder}/*.csv", SCHEMA, HEADER)
    got = sorted(map(tuple, parts.salvaged(done, found, "id", ["score"]).collect()))
    assert got == [(1, "late", 9.0), (2, "old", 1.0), (3, "u, v", 1.0), (7, None, 2.0), (8, "s", 3.0), (10, "k", 1.0)]
    assert 7 not in {r["id"] for r in parts.salvaged(done, found, "id", ["name", "score"]).collect()}


def test_torn_line_of_a_file_of_many_splits(spark, tmp_path):
    rows = [f"{i},n{i},{i}.25" for i in range(5000)]
    (tmp_path / "long.csv").write_text("\n".join([HEADER, *rows]))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        found = parts.read_parts(spark, f"{tmp_path}/long.csv", SCHEMA, HEADER)
        assert [r["id"] for r in found.where("_fault is null").orderBy("id").collect()] == list(range(4999))
        assert found.where("_fault = 'torn'").count() == 1 and found.where("_fault <> 'torn'").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_versions_of_a_table(spark, tmp_path, monkeypatch):
    folder = f"{tmp_path}/t"
    assert parts.current_table(spark, folder) is None
    parts.replace_table(spark.range(3), folder)
    parts.replace_table(parts.current_table(spark, folder).union(spark.range(7, 9)), folder)
    assert sorted(r["id"] for r in parts.current_table(spark, folder).collect()) == [0, 1, 2, 7, 8]

    def fails(*_):
        raise OSError("lost")

    monkeypatch.setattr(parts.files, "put", fails)
    with pytest.raises(OSError):
        parts.replace_table(spark.range(1), folder)
    assert parts.current_table(spark, folder).count() == 5
