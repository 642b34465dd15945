"""Operators of rankings and their evaluation on fixtures, and every query that has SQL against DuckDB."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lodestack.functions.text import search_tokens, stable_id
from lodestack.operators import dense, evaluate, fusion, lexical, retrieval
from lodestack.operators.numbering import numbered
from lodestack.operators.titles import title_filter
from lodestack.plans import catalog
from lodestack.sources.settings import load_title_rules

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "embeddings", "part", "pages", "events")


def comparable(rows, names):
    fixed = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else round(float(x), 5) if isinstance(x, (float, int)) and not isinstance(x, bool) else x
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(fixed(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = db.sql(catalog.oracle_sql()[name])
    got = __spark_entry__.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert comparable(got.collect(), got.columns) == comparable(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize(
    "text, want",
    [
        ("C++ C#11 .NET asp.net abc..net", ["c++", "c#11", ".net", "asp.net", "abc", ".net"]),
        ("_c++ c++x c++17", ["c", "c", "x", "c++17"]),
        ("Node.js CI/CD résumé", ["node.js", "ci/cd", "r", "sum"]),
        ("a-b_c/d:e+f", ["a-b_c/d:e+f"]),
        ("Plain words, 3.5 of x-y é", ["plain", "words", "3.5", "of", "x-y"]),
        ("Kelvin ſo plain", ["kelvin", "so", "plain"]),
        (None, []),
    ],
)
def test_search_tokens(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(search_tokens("t")).first()[0]
    assert [t.replace("ſ", "s") for t in got] == want


def test_stable_id(spark):
    df = spark.createDataFrame([("greenhouse", " acme\t", "42")], "a string, b string, c string")
    assert df.select(stable_id(F.col("a"), F.col("b"), F.col("c"))).first()[0] == "4e1b99c08c4b9d7faa6934cffdac51787db2a829419435bc56f03f3e506953a9"
    for bad in (None, " ", ""):
        with pytest.raises(Exception, match="not blank"):
            df.select(stable_id(F.col("a"), F.lit(bad).cast("string"), F.col("c"))).collect()


def test_bm25_pads_and_ranks(spark):
    docs = spark.createDataFrame([("n1", "Python APIs on AWS. Python tests."), ("n2", "Deploy services on Kubernetes with CI/CD"), ("n3", "Plan retail pricing")], "id string, t string")
    asked = spark.createDataFrame([(1, "python on on AWS"), (2, "ci/cd"), (3, None)], "q long, t string")
    got = [tuple(r) for r in lexical.bm25_topk(docs, asked, 3, "id", "t", "q", "t").orderBy("query", "rank").collect()]
    assert got == [
        (1, "n1", 2.647589, 1), (1, "n2", 0.431196, 2), (1, "n3", 0.0, 3), (2, "n2", 0.899843, 1), (2, "n1", 0.0, 2), (2, "n3", 0.0, 3),
        (3, "n1", 0.0, 1), (3, "n2", 0.0, 2), (3, "n3", 0.0, 3),
    ]
    assert lexical.bm25_topk(docs.limit(0), asked, 3, "id", "t", "q", "t").count() == 0
    assert [r["node"] for r in lexical.bm25_topk(docs, asked.where("q = 2"), 1, "id", "t", "q", "t").collect()] == ["n2"]
    with pytest.raises(ValueError, match="repeat"):
        lexical.build_index(docs.union(docs.limit(1)), "id", "t")


def test_bm25_ranks_scores_whole(spark):
    """Scores that agree in six digits are still told apart."""
    docs = spark.createDataFrame([(1, "a " * 50 + "b " * 400_000), (2, "a " * 50 + "b " * 399_999), (3, "c")], "id long, t string")
    got = lexical.bm25_topk(docs, spark.createDataFrame([(1, "a")], "q long, t string"), 2, "id", "t", "q", "t", k1=1.5, b=0.0001).orderBy("rank").collect()
    assert [r["node"] for r in got] == [2, 1] and got[0]["score"] == got[1]["score"]


def test_dense_against_numpy(spark):
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(300, 8))
    rows[7] = rows[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>").repartition(5)
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    scores = np.round(unit[::20] @ unit.T, 12)
    want = {(20 * q, int(n)): k + 1 for q, row in enumerate(scores) for k, n in enumerate(np.lexsort((np.arange(300), -row))[:6])}
    got = dense.dense_topk(df, df.where("vec_id % 20 = 0"), 6, block=4)
    assert {(r["query"], r["node"]): r["rank"] for r in got.collect()} == want
    assert dense.dense_topk(df, df.limit(0), 6).count() == 0 and dense.dense_topk(df.limit(0), df, 6).count() == 0


def test_dense_products_are_spared(spark):
    """Vectors in groups: the same rows as all products give, with a part of them."""
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(12, 16))
    rows = np.concatenate([c + 0.05 * rng.normal(size=(400, 16)) for c in centers])
    rows[100], rows[4000] = rows[5], rows[5]
    rng.shuffle(rows)
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    scores = np.round(unit[::40] @ unit.T, 12)
    want = {(40 * q, int(n)): r + 1 for q, row in enumerate(scores) for r, n in enumerate(np.lexsort((np.arange(len(rows)), -row))[:7])}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>").repartition(2)
    asked = df.where("vec_id % 40 = 0")
    assert {(r["query"], r["node"]): r["rank"] for r in dense.dense_topk(df, asked, 7, block=256).collect()} == want
    made, whole = dense.products(df, asked, 7, block=256).first()
    assert whole == len(rows) * len(scores) and made < whole / 2
    assert dense.products(df.limit(0), asked, 7).first() == (0, 0)


@pytest.mark.parametrize("bad, error", [(None, "null"), ([1.0], "length"), ([float("nan"), 1.0], "not_finite"), ([0.0, 0.0], "zero"), ([None, 1.0], "not_finite")])
def test_bad_vectors_are_named(spark, bad, error):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0]), (77, bad)], "vec_id long, embedding array<double>").coalesce(1)
    assert [tuple(r) for r in dense.vector_errors(df, "vec_id", "embedding", 2).collect()] == [(77, error)]
    with pytest.raises(Exception, match="77"):
        dense.dense_topk(df, df.limit(1), 2).collect()


def test_rrf_and_candidates(spark):
    schema = "query long, node string, rank long"
    a = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], schema)
    b = spark.createDataFrame([(1, "c", 1), (1, "a", 2), (1, "d", 3)], schema)
    got = {r["node"]: r for r in fusion.rrf(a, b).collect()}
    assert [got[n]["rank"] for n in "acbd"] == [1, 2, 3, 4] and got["a"]["score"] == 0.03252247488101534 and got["b"]["second_rank"] is None
    assert {r["node"]: r["score"] for r in fusion.rrf(b, a).collect()} == {n: r["score"] for n, r in got.items()}
    listed = fusion.rerank_candidates(a, b).orderBy("position").collect()
    assert [r["node"] for r in listed] == ["a", "b", "c", "d"]


def test_numbers_within_groups(spark):
    rng = np.random.default_rng(3)
    rows = [(["a", "a", "a", "b", None][int(rng.integers(0, 5))], int(v)) for v in rng.permutation(2000)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(7)
    want, last = {}, {}
    for g, v in sorted(rows, key=lambda r: r[1]):
        last[g] = want[g, v] = last.get(g, 0) + 1
    got = numbered(df, "g", ["v"], "n")
    assert got.columns == ["g", "v", "n"] and {(r["g"], r["v"]): r["n"] for r in got.collect()} == want
    assert numbered(df.limit(0), "g", ["v"], "n").count() == 0


def test_containment_of_short_and_long_items(spark):
    texts = ["one two three four five six", "xone two threex", "two", "a one  two three", None, "", "seven eight nine ten"]
    items = ["two", "one two", "one two three", "two three four five", "one two three four five six", "eight nine", "", None, "nine te"]
    docs, asked = spark.createDataFrame(list(enumerate(texts)), "d long, t string"), spark.createDataFrame(list(enumerate(items)), "i long, t string")
    want = {(q, n) for q, item in enumerate(items) for n, text in enumerate(texts) if item is not None and text is not None and item in text}
    got = evaluate.containment_qrels(docs, asked, "d", "t", "i", "t").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert evaluate.containment_qrels(docs, asked.limit(0), "d", "t", "i", "t").count() == 0


@pytest.mark.parametrize("most", [50_000, 7])
def test_short_items_against_every_text(spark, monkeypatch, most):
    monkeypatch.setattr(evaluate, "SHORT_ITEMS", most)
    rng = random.Random(1)
    parts = ["ab", "b", "cé", "日本", "a", " ", "\n", "x y"]
    texts = [(k, None if k == 3 else "".join(rng.choices(parts, k=rng.randrange(0, 12)))) for k in range(60)]
    items = [(f"q{k}", "".join(rng.choices(parts, k=rng.randrange(0, 4)))) for k in range(80)] + [("none", None), ("same", "ab"), ("same", "ab")]
    found = evaluate.containment_qrels(spark.createDataFrame(texts, "id long, t string").repartition(3), spark.createDataFrame(items, "q string, t string"), "id", "t", "q", "t")
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == sorted({(q, k) for q, i in items for k, t in texts if None not in (i, t) and i in t})
    nothing = spark.createDataFrame([], "q string, t string")
    assert evaluate.containment_qrels(spark.createDataFrame(texts, "id long, t string"), nothing, "id", "t", "q", "t").collect() == []


def test_score_rankings(spark):
    ranked = spark.createDataFrame([("m", 1, n, k + 1) for k, n in enumerate(["x", "y", "g1", "z", "g2"])] + [("m", 2, "x", 1), ("m", 2, "g1", 6)], "method string, query long, node string, rank long")
    gold = spark.createDataFrame([(1, "g1"), (1, "g2"), (2, "g1")], "query long, node string")
    got = {r["query"]: (r["hit"], r["rr"], r["first_rank"]) for r in evaluate.score_rankings(ranked, gold, by=["method"]).collect()}
    assert got == {1: (1, 1 / 3, 3), 2: (0, 0.0, None)}


def pairs_of(spark, n=60):
    rng = np.random.default_rng(4)
    rows = []
    for p in range(n):
        for m, lift in zip(evaluate.METHODS, (0.5, 0.3, 0.7), strict=True):
            hits = [int(rng.random() < lift + 0.2), int(rng.random() < lift - 0.2)]
            rrs = [h / int(rng.integers(1, 6)) for h in hits]
            rows.append((p, m, str(p % 3), f"{p}_h", f"{p}_l", *hits, hits[0] - hits[1], *rrs, rrs[0] - rrs[1], f"{'hit' if hits[0] else 'miss'}→{'hit' if hits[1] else 'miss'}"))
    schema = "pair long, method string, family string, high_query string, low_query string, high_hit long, low_hit long, hit_drop long, high_rr double, low_rr double, rr_drop double, transition string"
    return spark.createDataFrame(rows, schema), rows


@pytest.mark.parametrize("make", [lambda s, n: evaluate.hashed_draws(s, n, 200, 3), lambda s, n: evaluate.twister_draws(s, n, 200, 3)])
def test_bootstrap_against_numpy(spark, make):
    outcomes, rows = pairs_of(spark)
    draws = make(spark, 60)
    drawn = {}
    for r in draws.collect():
        drawn.setdefault(r["replicate"], []).append(r["idx"])
    assert len(drawn) == 200 and all(len(d) == 60 for d in drawn.values()) and min(len(set(d)) for d in drawn.values()) < 45, "draws repeat"
    values = {m: np.array([r[7] for r in rows if r[1] == m], float) for m in evaluate.METHODS}
    means = {m: np.array([values[m][drawn[k]].mean() for k in sorted(drawn)]) for m in values}
    tables = evaluate.summarize_pairs(outcomes, draws, 200)
    got = {(r["method"], r["metric"]): r for r in tables["bootstrap_intervals"].collect()}
    assert len(got) == 18
    for m in values:
        r = got[m, "hit_drop"]
        assert r["low"] < r["high"] and r["estimate"] == round(values[m].mean(), 6)
        assert [r["low"], r["high"]] == pytest.approx(np.percentile(means[m], [2.5, 97.5]), abs=2e-6)
    less = {(r["method_a"], r["method_b"], r["metric"]): r for r in tables["method_drop_differences"].collect()}
    assert len(less) == 6
    r = less["hybrid", "dense", "hit_drop"]
    assert [r["low"], r["high"]] == pytest.approx(np.percentile(means["hybrid"] - means["dense"], [2.5, 97.5]), abs=2e-6)
    counts = tables["transition_summary"].collect()
    assert len(counts) == 12 and sum(c["pairs"] for c in counts) == 180
    assert sum(r["pair_count"] for r in tables["family_descriptive"].collect()) == 180
    with pytest.raises(ValueError):
        evaluate.summarize_pairs(outcomes, draws, 99)
    with pytest.raises(ValueError):
        evaluate.summarize_pairs(outcomes, draws, 200, 1.0)


def test_twister_draws_are_pythons(spark):
    first = [r["idx"] for r in evaluate.twister_draws(spark, 80, 100, 20260927).limit(8).collect()]
    assert first == [30, 62, 40, 15, 9, 9, 63, 51]
    twister = random.Random(5)
    want = [(r, twister.randrange(33)) for r in range(100) for _ in range(33)]
    got = evaluate.twister_draws(spark, 33, 100, 5).collect()
    assert sorted((r["replicate"], r["idx"]) for r in got) == sorted(want) and [tuple(r) for r in got] == want


class Overlap:
    def compute_score(self, pairs):
        return [len(set(q.lower().split()) & set(t.lower().split())) for q, t in pairs]


class Letters:
    def encode(self, texts):
        return np.array([[1 + t.count(c) for c in "abcdefgh"] for t in texts], float)


@pytest.fixture(scope="module")
def run(spark):
    """A whole run over 60 passages and 8 pairs."""
    rng = np.random.default_rng(8)
    words = [f"{a}{b}word" for a in "abcdefgh" for b in "klmnopqrst"]
    texts = [" ".join(rng.choice(words, 12)) for _ in range(60)]
    nodes = spark.createDataFrame([(f"n{i:02d}", t, f"j{i // 3}", "Title", "Company", None, t) for i, t in enumerate(texts)], "node_id string, retrieval_text string, job_id string, title string, company string, section_heading string, content_text string")
    rows, gold = [], []
    for p in range(8):
        for kind, part in zip(evaluate.KINDS, (texts[p * 5], " ".join(texts[p * 5].split()[:2])), strict=True):
            rows.append((f"q{p}{kind[0]}", f"p{p}", kind, part, f"j{p * 5 // 3}", "f", texts[p * 5], [f"n{p * 5:02d}"]))
            gold.append((f"q{p}{kind[0]}", [f"n{p * 5:02d}"]))
    queries = spark.createDataFrame(rows, "query_id string, pair_id string, query_type string, query string, source_job_id string, source_job_family string, evidence_text string, evidence_node_ids array<string>")
    qrels = spark.createDataFrame(gold, "query_id string, evidence_node_ids array<string>")
    results = retrieval.written(retrieval.run_retrieval(nodes, queries, Letters, "run-1", "hash"), "results")
    reranked = retrieval.written(retrieval.rerank_queries(results, queries, nodes, Overlap, "run-2", "hash"), "reranked")
    return nodes, queries, qrels, results, reranked


def test_run_is_complete_and_scored(spark, run):
    nodes, queries, qrels, results, reranked = run
    times = {r["method"]: r for r in results.collect()}
    own = {m: r["elapsed_ms"] for m, r in times.items()}
    assert 0 < own["bm25"] and 0 < own["dense"] and own["hybrid"] > own["bm25"] + own["dense"]
    assert own["dense"] == pytest.approx((times["dense"]["dense_query_encoding_batch_ms"] + times["dense"]["dense_ranking_batch_ms"]) / 16) and min(times["bm25"]["bm25_index_ms"], times["bm25"]["dense_corpus_encoding_ms"]) > 0
    assert results.count() == 3 * 16 and {len(r["ranked_node_ids"]) for r in results.collect()} == {20}
    scores = evaluate.evaluate_results(results, qrels, queries)
    assert [r["method"] for r in scores.limit(3).collect()] == list(evaluate.METHODS)
    best = {(r["query_id"], r["method"]): r for r in scores.collect()}
    assert all(best[f"q{p}h", "bm25"]["first_source_evidence_rank"] == 1 for p in range(8))
    assert evaluate.pair_errors(scores).count() == 0
    for r in reranked.collect():
        assert sorted(r["candidate_node_ids"]) == sorted(r["ranked_node_ids"]) and 20 <= r["candidate_count"] <= 40
        order = [(-x["score"], x["node_id"]) for x in r["ranked_results"]]
        assert order == sorted(order) and [x["rank"] for x in r["ranked_results"]] == list(range(1, len(order) + 1))
    tables = evaluate.analyze_reranked(results, reranked, queries, qrels, evaluate.hashed_draws(spark, 8, 100), 100)
    assert tables["main_table"].count() == 4 and tables["paired_differences"].count() == 18
    coverage = {(r["kind"], r["method"]): r["covered"] for r in tables["candidate_coverage"].collect()}
    assert len(coverage) == 8 and coverage[evaluate.KINDS[0], "bm25_dense_union"] == 8


@pytest.mark.parametrize(
    "change, error",
    [
        (lambda r: r.where("method <> 'dense' OR query_id <> 'q0h'"), "missing"),
        (lambda r: r.union(r.limit(1)), "duplicate"),
        (lambda r: r.withColumn("run_id", F.when(F.col("query_id") == "q0h", "x").otherwise(F.col("run_id"))), "several_runs"),
        (lambda r: r.withColumn("ranked_node_ids", F.when(F.col("query_id") == "q0h", F.array_repeat(F.lit("n00"), 20)).otherwise(F.col("ranked_node_ids"))), "repeated_node"),
        (lambda r: r.withColumn("ranked_results", F.slice("ranked_results", 2, 19)), "ids_differ"),
        (lambda r: r.withColumn("config_hash", F.lit("")), "no_run"),
    ],
)
def test_incomplete_runs_are_refused(run, change, error):
    _, queries, qrels, results, _ = run
    with pytest.raises(ValueError, match=error):
        evaluate.evaluate_results(change(results), qrels, queries)


def test_bad_gold_is_refused(run):
    _, queries, qrels, results, _ = run
    for bad, error in ((F.array().cast("array<string>"), "no_gold"), (F.array(F.lit("n01"), F.lit("n01")), "duplicate_gold"), (F.array(F.lit("n59")), "gold_differs")):
        with pytest.raises(ValueError, match=error):
            evaluate.evaluate_results(results, qrels.withColumn("evidence_node_ids", F.when(F.col("query_id") == "q0h", bad).otherwise(F.col("evidence_node_ids"))), queries)


def test_bad_scores_are_refused(run):
    nodes, queries, _, results, _ = run

    class Short:
        def compute_score(self, pairs):
            return [1.0]

    class Odd:
        def compute_score(self, pairs):
            return [float("nan")] * len(pairs)

    for scorer in (Short, Odd):
        with pytest.raises(Exception, match="scorer"):
            retrieval.rerank_queries(results, queries, nodes, scorer, "r", "h").collect()


@pytest.mark.parametrize(
    "title, employment, want",
    [
        ("Senior Data Scientist", None, ("accepted", "data_science_analytics")), ("Working Student Software Engineer", None, ("internship", None)), ("Data Analyst", "Internship", ("internship", None)),
        ("Co-op Data Scientist", None, ("internship", None)), ("AI Platform Engineer", None, ("non_target", None)), ("AI Software Engineer", None, ("accepted", "software_engineering")),
        ("Full-Stack Engineer", None, ("accepted", "software_engineering")), ("Internal Tools Software Engineer", "", ("accepted", "software_engineering")),
        ("Software Engineer / Data Analyst", None, ("ambiguous", None)), ("Software Engineering Manager", None, ("non_target", None)), (None, None, ("non_target", None)),
    ],
)
def test_title_rules(spark, title, employment, want):
    found = spark.createDataFrame([(title, employment)], "t string, e string").select(title_filter(F.col("t"), F.col("e"), **load_title_rules().as_arguments()).alias("f")).first()["f"]
    assert (found["status"], found["family"]) == want and (found["reason"] is None) == (want[0] == "accepted")
