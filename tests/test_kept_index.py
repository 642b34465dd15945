"""The kept index against the ranking that scores everything."""

import random

import pytest
from pyspark.sql import functions as F

from lodestack.operators import kept_index, lexical


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(1500):
        n = rng.choice([3, 8, 30, 30, 120])
        rows.append((k, " ".join(rng.choices(words, [1 / (i + 1) for i in range(400)], k=n))))
    rows += [(2000, None), (2001, ""), (None, "w1 w2"), (2002, "w1 " * 5000), *((3000 + k, rows[7][1]) for k in range(30))]
    path = str(tmp_path_factory.mktemp("kept") / "docs")
    spark.createDataFrame(rows, "id long, t string").repartition(3).write.parquet(path)
    queries = [(k, " ".join(rng.choices(words, k=rng.choice([1, 2, 5])))) for k in range(25)] + [(100, "w1 w2 w3 w399"), (101, "nothing"), (102, None), (103, "w0"), (104, rows[7][1])]
    return path, rows, spark.createDataFrame(queries, "q long, t string")


@pytest.mark.parametrize("k, constants", [(5, (1.5, 0.75)), (40, (0.6, 0.2)), (5, (1.2, 0.0))])
def test_rows_are_those_of_scoring_everything(spark, corpus, monkeypatch, k, constants):
    monkeypatch.setattr(kept_index, "RANGE", 32)
    monkeypatch.setattr(kept_index, "FIRST", 1)
    path, _, queries = corpus
    docs = spark.read.parquet(path)
    index = kept_index.kept_index(docs, "id", "t")
    ranked, counts = kept_index.search(index, queries, k, "q", "t", *constants)
    want = lexical.bm25_topk(docs, queries, k, "id", "t", "q", "t", *constants)
    assert sorted(map(tuple, ranked.collect())) == sorted(map(tuple, want.collect()))
    told = {r["query"]: (r["blocks"], r["scored"]) for r in counts.collect()}
    assert all(0 < scored <= blocks for blocks, scored in told.values()) and 101 not in told and 102 not in told
    if k == 5:
        assert sum(s for _, s in told.values()) < 0.9 * sum(b for b, _ in told.values()), sorted(told.items())


def test_blocks_hold_all_postings(spark, corpus):
    path, rows, _ = corpus
    index = kept_index.kept_index(spark.read.parquet(path), "id", "t")
    got = {(r["term"], r["node"]): (r["tf"], r["dl"]) for r in index.blocks.select("term", F.explode("docs").alias("d")).select("term", "d.*").collect()}
    want = {}
    for node, text in rows:
        if node is not None and text:
            words = text.split()
            want |= {(w, node): (words.count(w), len(words)) for w in set(words)}
    assert got == want
    assert index.blocks.select(F.max(F.size("docs"))).first()[0] < 2 * kept_index.RANGE
    assert index.n_docs == len(rows) - 1 and index.bounds.count() == index.blocks.count()


def test_a_second_use_reads_the_index_only(spark, corpus, monkeypatch):
    path, _, queries = corpus
    docs = spark.read.parquet(path)
    first = kept_index.kept_index(docs, "id", "t")
    monkeypatch.setattr(kept_index, "_build", None)
    again = kept_index.kept_index(spark.read.parquet(path), "id", "t")
    assert again.tokens.inputFiles() == first.tokens.inputFiles()
    ranked, _ = kept_index.search(again, queries, 3, "q", "t")
    assert not any(path in f for f in ranked.inputFiles())
    monkeypatch.undo()
    keys = {kept_index.input_key(d) for d in (docs, docs.where("id > 3"), docs.limit(9), docs.select("id"), spark.createDataFrame([(1, "a")], docs.schema), spark.createDataFrame([(1, "b")], docs.schema))}
    assert len(keys) == 6 and kept_index.input_key(spark.read.parquet(path)) in keys
    before = kept_index.input_key(docs)
    docs.limit(3).write.mode("append").parquet(path)
    assert kept_index.input_key(spark.read.parquet(path)) != before
    with pytest.raises(ValueError, match="repeat"):
        kept_index.kept_index(spark.read.parquet(path), "id", "t")
    kept_index.drop_index(docs, "id", "t")


def test_an_index_of_nothing(spark):
    docs = spark.createDataFrame([], "id string, t string")
    queries = spark.createDataFrame([(1, "a b")], "q long, t string")
    assert kept_index.bm25_rank(kept_index.kept_index(docs, "id", "t"), queries, 3, "q", "t").collect() == []
    one = spark.createDataFrame([("x", None), ("y", "b")], docs.schema)
    assert [r["node"] for r in kept_index.bm25_rank(kept_index.kept_index(one, "id", "t"), queries, 3, "q", "t").orderBy("rank").collect()] == ["y", "x"]
