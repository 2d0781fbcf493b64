"""Folders are listed in tasks; empty files are kept."""

import pytest

from braidwork.operators import merkle
from braidwork.sources import files


@pytest.fixture
def folder(tmp_path):
    base = tmp_path / "a b é%20"
    for name, content in {"t/prompt/1/p1.txt": "one\ntext", "t/prompt/1/p2.txt": "", "t/caption/1/c1.txt": "", "t/image/1/i1.png": "", "t/image/1/i10.png": "x", "t/image/1/i2.png": "y", "_hidden/x": "1", "u/.secret": "", "u/thumbs.db": "", "u/deep/er/empty": "", "top.txt": "ab"}.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_text(content)
    (base / "no files").mkdir()
    return base


def test_listing(spark, folder):
    got = {r.path.removeprefix(f"file:{folder}/"): (r.is_folder, r.size) for r in files.listing(spark, str(folder)).collect()}
    assert got["t/prompt/1/p2.txt"] == (False, 0) and got["t/prompt/1/p1.txt"] == (False, 8) and got["u/deep"][0] and got["no files"][0]
    assert not [p for p in got if "hidden" in p or "secret" in p] and len(got) == 9 + 11
    assert {r.path.rsplit("/", 1)[1] for r in files.listing(spark, str(folder), deep=False).collect()} == {"t", "u", "no files", "top.txt"}
    assert files.listing(spark, str(folder / "t" / "*")).where("NOT is_folder").count() == 6
    assert [r.path for r in files.listing(spark, str(folder / "top.txt")).collect()] == [f"file:{folder}/top.txt"]
    with pytest.raises(FileNotFoundError):
        files.listing(spark, str(folder / "nowhere"))


def test_empty_files_are_kept(spark, folder):
    rows = {r.path.removeprefix(f"file:{folder}/"): (r.name, bytes(r.content), r.size) for r in files.files(spark, str(folder)).collect()}
    assert rows["t/caption/1/c1.txt"] == ("c1.txt", b"", 0) and rows["u/deep/er/empty"] == ("empty", b"", 0) and rows["top.txt"] == ("top.txt", b"ab", 2)
    assert set(rows) == {"t/prompt/1/p1.txt", "t/prompt/1/p2.txt", "t/caption/1/c1.txt", "t/image/1/i1.png", "t/image/1/i10.png", "t/image/1/i2.png", "u/deep/er/empty", "top.txt"}


def test_media_with_empty_files(spark, folder):
    (row,) = files.media(spark, str(folder)).collect()
    assert row.title == "t" and row.prompt == ["one\ntext", ""] and row.caption == [""]
    assert [p.rsplit("/", 1)[1] for p in row.image] == ["i1.png", "i2.png", "i10.png"] and row.audio == []


def test_collections_of_empty_files(spark, folder):
    f = files.files(spark, str(folder / "t" / "image" / "1")).select("name", "content").withColumnRenamed("name", "path")
    t = spark.createDataFrame([("", "i1.png", 1), ("", "i2.png", 2), ("", "i10.png", 3)], "folder string, name string, tickets long")
    entries, refused = merkle.collections(f, t)
    got = {r.path: r.size for r in entries.collect()}
    assert got == {"": 2, "i1.png": 0, "i10.png": 1, "i2.png": 1} and refused.count() == 0


def test_numbers_of_empty_files(spark, folder):
    got = files.prompt_numbers(spark, str(folder / "t" / "image" / "1"))
    assert sorted(r.n for r in got.collect()) == [1, 2, 10]
