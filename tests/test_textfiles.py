"""Texts as named files, few thousand to a folder, and back."""

from collections import Counter

import pytest

from textloom.sources import readers, textfiles, writers


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_texts_are_named_files_in_few_folders(spark, tmp_path, scheme):
    path = tmp_path / "texts"
    names = [f"{i}_cefr_B2_level_11_grade_9" for i in range(500)]
    df = spark.createDataFrame([(n, f"text {n}\n\n") for n in names], "name string, text string")
    for _ in range(2):  # the second replaces the first
        writers.write_texts(df, f"{scheme}{path}", "name", "text")
        assert sorted(p.name for p in path.glob("*/*.txt")) == sorted(f"{n}.txt" for n in names)
    assert sum(p.is_dir() for p in path.iterdir()) <= 4
    assert Counter(map(tuple, readers.read_texts(spark, f"{scheme}{path}").collect())) == Counter((n, f"text {n}\n\n") for n in names)
    found = readers.read_text_files(spark, f"{path}/*").collect()
    assert {(r["filename"], r["cefr_level"], r["level"]) for r in found} == {(f"{n}.txt", "B2", 11) for n in names}


def test_hard_names_and_texts(spark, tmp_path):
    rows = [("a/b", "x"), ("..", ""), ("_c", "é\n"), ("%41", "\r\n"), ("A", "q\0r"), (None, "none"), (None, "none"), ("", "empty"), ("x", "1"), ("x", "2"), ("x", "2"), ("x%r1", "3"), ("y.txt", "4"), ("z:ö", None)]
    writers.write_texts(spark.createDataFrame(rows, "name string, text string").repartition(5), str(tmp_path / "t"), "name", "text")
    assert Counter(map(tuple, readers.read_texts(spark, str(tmp_path / "t")).collect())) == Counter((n, t or "") for n, t in rows)
    writers.write_texts(spark.createDataFrame([], "name string, text string"), str(tmp_path / "none"), "name", "text")
    assert readers.read_texts(spark, str(tmp_path / "none")).count() == 0


def test_failed_task_leaves_nothing(spark, tmp_path):
    long = spark.createDataFrame([("a", "x"), ("n" * 300, "y")], "name string, text string")
    with pytest.raises(Exception, match="too long"):
        writers.write_texts(long, str(tmp_path / "t"), "name", "text")
    with pytest.raises(Exception, match="no finished folder"):
        readers.read_texts(spark, str(tmp_path / "t")).collect()


def test_folders_are_bounded(tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(textfiles, "FOLDER", 10)
    writer = textfiles.Writer(str(tmp_path), False)
    made = writer.write(iter([pa.RecordBatch.from_pydict({"filename": [f"{i:03}" for i in range(k, k + 25)], "text": ["x"] * 25}) for k in (0, 25)]))
    writer.commit([made, None])
    assert sorted(len(list(p.iterdir())) for p in tmp_path.iterdir() if p.is_dir()) == [10] * 5
