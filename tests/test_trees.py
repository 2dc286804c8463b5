"""Directory trees that tasks list, read and write."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from millrace.sources import trees


def test_trees_come_back_as_written(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    names = {"/".join(rng.choice("abcd") for _ in range(rng.randrange(1, 6))) + f"/f{i}.{rng.choice(['txt', 'YML', 'log'])}" for i in range(300)}
    files = {n: "".join(rng.choice(["x", "é", "\n", "\r\n", "😀", " "]) for _ in range(rng.randrange(40))) for n in sorted(names)}
    df = spark.createDataFrame(list(files.items()), "n string, c string")
    root = str(tmp_path / "tree")
    assert trees.write_files(df, root, F.col("n"), F.col("c")) == 300
    assert trees.write_files(df.limit(5), root, F.col("n"), F.col("c")) == 5  # once more does no harm
    (tmp_path / "tree" / ".hidden").write_text("no")
    (tmp_path / "tree" / "_folder").mkdir()
    for address in (root, "file:" + root, "file://" + root):
        listing = trees.list_files(spark, address)
        assert {r.name: r.size for r in listing.collect()} == {n: len(c.encode()) for n, c in files.items()}
    monkeypatch.setattr(trees, "BATCH_BYTES", 50)
    monkeypatch.setattr(trees, "BATCH_ROWS", 7)
    listing = trees.list_files(spark, root)
    assert {r["name"]: r["content"] for r in trees.read_files(listing, root).collect()} == files
    lines = {}
    for r in trees.read_lines(listing, root).orderBy("name", "line_no").collect():
        lines.setdefault(r["name"], []).append(r["line"])
    split = {n: c.replace("\r\n", "\n").split("\n") for n, c in files.items()}
    assert lines == {n: (x[:-1] if x[-1] == "" else x) for n, x in split.items() if x != [""]}
    wanted = trees.list_files(spark, root, ["yml"])
    assert {r["name"] for r in wanted.collect()} == {n for n in files if n.endswith("YML")}


def test_rows_of_a_file_follow_their_order(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("f"), (999 - F.col("id")).alias("at"))
    root = str(tmp_path)
    trees.write_files(df, root, F.concat(F.lit("d/"), "f"), F.concat(F.col("at").cast("string"), F.lit("\n")), ["at"])
    for f in range(3):
        with open(os.path.join(root, "d", str(f))) as file:
            assert [int(x) for x in file] == [at for at in range(1000) if (999 - at) % 3 == f]


def test_odd_trees(spark, tmp_path):
    root = str(tmp_path)
    assert trees.list_files(spark, root).count() == 0
    assert trees.read_files(trees.list_files(spark, root), root).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        trees.list_files(spark, root + "/nowhere").count()
    (tmp_path / "bad").write_bytes(b"\xff\xfeok\n")
    (tmp_path / "empty").write_bytes(b"")
    read = {r["name"]: r["content"] for r in trees.read_files(trees.list_files(spark, root), root).collect()}
    assert read == {"bad": "��ok\n", "empty": ""}
    assert trees.write_files(spark.createDataFrame([], "n string, c string"), root, F.col("n"), F.col("c")) == 0
