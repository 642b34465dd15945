"""Digests of tables, numbers of lines, and tables that are replaced whole."""

import hashlib
import json
import random
from pathlib import Path

import pytest

from lodestack import storage
from lodestack.sources import digests, files


def naive_digest(rows, names):
    """The tree over rows as tuples, with plain dictionaries."""
    said = lambda name, v: name + ("-" if v is None else f"{len(str(v).encode())}:{v}")
    order = sorted(range(len(names)), key=lambda k: names[k])
    counts = {}
    for row in rows:
        key = hashlib.sha256("".join(said(names[k], row[k]) for k in order).encode()).hexdigest()
        counts[key] = counts.get(key, 0) + 1
    level, depth = {k: f"{k}:{n}" for k, n in counts.items()}, digests.depth_of(len(counts))
    for width in range(2 * depth, -1, -2):
        groups = {}
        for key, text in level.items():
            groups.setdefault(key[:width], []).append(text)
        if not groups:
            return hashlib.sha256(b"").hexdigest()
        level = {key: f"{key}:{hashlib.sha256(','.join(sorted(texts)).encode()).hexdigest()}" for key, texts in groups.items()}
    return level[""].removeprefix(":")


def test_digest_of_any_partitioning(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, k]), rng.choice([None, "", "é", "a:1", str(k)])) for k in range(900)] + [(7, "hot")] * 400
    df = spark.createDataFrame(rows, "b long, a string")
    want = naive_digest(rows, ["b", "a"])
    assert digests.depth_of(len(set(rows))) == 1
    rng.shuffle(rows)
    for other in (df, df.coalesce(1), df.repartition(9), spark.createDataFrame(rows, df.schema).select("a", "b")):
        assert digests.table_digest(other) == want
    for changed in (rows[1:], [*rows, rows[0]], [(1, "new"), *rows[1:]], [(r[0], r[1] or None) for r in rows]):
        assert digests.table_digest(spark.createDataFrame(changed, df.schema)) != want
    assert digests.table_digest(df.withColumnRenamed("a", "c")) != want
    assert digests.table_digest(df.limit(0)) == hashlib.sha256(b"").hexdigest()
    assert digests.table_digest(df.limit(0).repartition(3)) == digests.table_digest(spark.createDataFrame([], "x int"))


def test_digest_of_every_kind_of_column(spark):
    df = spark.sql("SELECT map('a', array(1, null)) m, named_struct('x', binary('q'), 'y', null) s, binary('z') b, timestamp'2024-01-02 03:04:05.000006' t, date'2024-01-02' d, 1.50 n, double('nan') f, true o")
    first = digests.table_digest(df)
    spark.conf.set("spark.sql.session.timeZone", "America/Lima")
    try:
        moved = df.withColumn("t", df["t"])
        assert digests.table_digest(moved.select(*df.columns[:3], *df.columns[4:])) == digests.table_digest(df.drop("t")) and first
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_a_bad_line_is_named(spark, tmp_path):
    folder = tmp_path / "rows"
    folder.mkdir()
    lines = [json.dumps({"z": k, "t": "x" * (k % 50)}) for k in range(3000)]
    lines[100] = ""
    (folder / "a.jsonl").write_text("\n".join(lines) + "\n")
    (folder / "b.jsonl").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 5
        got = [(Path(r["file"]).name, r["line"], r["row"], r["value"]) for r in files.numbered_lines(spark, str(folder)).orderBy("row").collect()]
        assert got == [(name, k + 1, 3000 * f + k + 1, line) for f, name in enumerate(("a.jsonl", "b.jsonl")) for k, line in enumerate(lines)]
        assert files.bad_lines(spark, str(folder), "z long").count() == 0
        assert files.read_jsonl(spark, str(folder), "z long", check=True).count() == 5998
        for at, bad in ((2500, "[1]"), (2900, '{"z": "no"}'), (1, "{"), (2999, '"x"')):
            (folder / "b.jsonl").write_text("\n".join([*lines[:at], bad, *lines[at + 1 :]]))
            with pytest.raises(ValueError, match=rf"b\.jsonl:{at + 1}:"):
                files.read_jsonl(spark, str(folder), "z long", check=True)
            with pytest.raises(Exception):
                files.read_jsonl(spark, str(folder), "z long").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "none.jsonl").write_text("")
    assert files.numbered_lines(spark, str(tmp_path / "none.jsonl")).count() == 0 and files.read_jsonl(spark, str(tmp_path / "none.jsonl"), "z long", check=True).count() == 0


def test_a_replaced_table_is_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "deep" / "rows")
    old, new = spark.range(5).toDF("x"), spark.range(9).toDF("x")
    files.write_jsonl(old, path)
    failing = new.selectExpr("CASE WHEN x < 8 THEN x ELSE raise_error('stop') END AS x")
    with pytest.raises(Exception, match="stop"):
        files.write_jsonl(failing, path, overwrite=True)
    assert files.read_jsonl(spark, path, "x long").count() == 5

    whole = files.rename_path

    def dies(session, source, target):
        if ".new-" in source:
            raise KeyboardInterrupt
        whole(session, source, target)

    monkeypatch.setattr(files, "rename_path", dies)
    with pytest.raises(KeyboardInterrupt):
        files.write_jsonl(new, path, overwrite=True)
    monkeypatch.undo()
    assert not Path(path).exists()
    assert files.read_jsonl(spark, path, "x long").count() == 5 and Path(path).exists()
    files.write_jsonl(new, path, overwrite=True)
    assert files.read_jsonl(spark, path, "x long").count() == 9 and not storage.path_exists(spark, str(tmp_path / "deep" / ".rows.old"))


def test_tables_are_copied_by_lines(spark, tmp_path):
    source = files.write_jsonl(spark.range(50).repartition(4), str(tmp_path / "rows"))
    made = files.copy_frozen({"copy": source}, tmp_path / "to")
    assert digests.lines_digest(spark, str(made["copy"])) == digests.lines_digest(spark, source)
    files.copy_frozen({"copy": source}, tmp_path / "to")
    files.write_jsonl(spark.range(49), source, overwrite=True)
    with pytest.raises(ValueError, match="differs"):
        files.copy_frozen({"copy": source}, tmp_path / "to")
