"""Folders listed by level, files and members that are not selected and so not opened, archives read by offset."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from driftlens.sources import trees


def rows(df):
    found = {r["rel"]: (r["content"] and bytes(r["content"]), r["list_error"]) for r in df.collect()}
    return found


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "t"
    for rel in ("a.c", "_b.c", ".hidden", "d/e/f/deep.c", "d/e/x.txt", "d/é ü.c", ".git/no", "d/.svn/no"):
        (root / rel).parent.mkdir(parents=True, exist_ok=True)
        (root / rel).write_bytes(rel.encode())
    (root / "empty").mkdir()
    os.symlink(root / "d", root / "link")
    os.symlink(root / "a.c", root / "same.c")
    os.symlink(root / "none", root / "broken.c")
    return root


def test_folders_are_listed_by_level(spark, folder):
    got = rows(trees.read_tree(spark, str(folder)))
    want = {r: (r.encode(), None) for r in ("a.c", "_b.c", ".hidden", "d/e/f/deep.c", "d/e/x.txt", "d/é ü.c")} | {"same.c": (b"a.c", None)}
    assert "No such file" in got.pop("broken.c")[1] and got == want
    levels = trees.listed(spark, str(folder))
    assert levels.where("kind = 'dir'").count() == 4 and levels.where("kind = 'error'").isEmpty()
    spark.dataSource.register(trees.TreeSource)
    assert {r for r in rows(spark.read.format("tree").load(str(folder)))} == {*want, "broken.c"}


def test_a_folder_that_vanishes_is_a_row(spark, tmp_path):
    (tmp_path / "x").mkdir()
    got = rows(trees.read_folder(spark, str(tmp_path / "gone")))
    assert list(got) == ["."] and "No such file" in got["."][1]
    assert rows(trees.read_folder(spark, str(tmp_path / "x"))) == {}


def test_what_is_not_selected_is_not_opened(spark, folder):
    """To open a pipe that nobody writes to would never end."""
    os.mkfifo(folder / "d" / "pipe.bin")
    got = rows(trees.read_tree(spark, str(folder), ["*.c", "*.bin"], ["*.bin", "same*", "broken*"]))
    assert set(got) == {"a.c", "_b.c", "d/e/f/deep.c", "d/é ü.c"}
    spark.dataSource.register(trees.TreeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        source = spark.read.format("tree").option("push", "true").load(str(folder))
        assert rows(source.where("rel = 'a.c'")) == {"a.c": (b"a.c", None)} and set(rows(source.where(F.col("rel").startswith("d/e")))) == {"d/e/f/deep.c", "d/e/x.txt"}
        assert set(rows(source.where(F.col("rel").isin("_b.c", "nope")))) == {"_b.c"}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA])
def test_members_are_read_from_their_offsets(spark, tmp_path, method, monkeypatch):
    monkeypatch.setattr(trees, "FILES_PER_TASK", 7)
    path, want = str(tmp_path / "t.zip"), {}
    with zipfile.ZipFile(path, "w", method) as z:
        for k in range(40):
            want[f"d{k % 3}/f{k}.c"] = (f"text {k} ".encode() * k, None)
            z.writestr(f"top/d{k % 3}/f{k}.c", want[f"d{k % 3}/f{k}.c"][0])
        z.writestr("top/.git/x", "no")
    df = trees.read_tree(spark, path)
    assert rows(df) == want and df.rdd.getNumPartitions() == 5
    assert set(rows(trees.read_tree(spark, path, ["*1.c"]))) == {r for r in want if r.endswith("1.c")}


def test_a_broken_member_costs_no_other(spark, tmp_path):
    path = str(tmp_path / "t.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("a.c", "first")
        z.writestr("b.c", "second")
    data = open(path, "rb").read()
    with open(path, "wb") as f:
        f.write(data.replace(b"second", b"broken"))
    got = rows(trees.read_tree(spark, path))
    assert got["a.c"] == (b"first", None) and got["b.c"][0] is None and "checksum" in got["b.c"][1]
