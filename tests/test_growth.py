"""What a ranking or a search moves between tasks follows its input or its result, not the matches in between."""

import random

import pytest
from pyspark.sql import functions as F

from lodestack.operators import batches, chunks, evaluate, evidence, kept_index, lexical, report
from lodestack.plans import ranking

SF = "/root/testdata/sf0.001"


def shuffled(spark, make):
    """Rows that the stages of ``make`` wrote to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none, bus = spark.sparkContext._jvm.java.util.ArrayList(), spark.sparkContext._jsc.sc().listenerBus()
    quantiles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def total():
        bus.waitUntilEmpty(30_000)
        found = store.stageList(none, False, False, quantiles, none)
        return {(found.apply(k).stageId(), found.apply(k).attemptId()): found.apply(k).shuffleWriteRecords() for k in range(found.size())}

    before = total()
    out = make()
    return out, sum(n for key, n in total().items() if key not in before)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=rng.choice([2, 9, 40]))) for _ in range(300)]
    rows = [(f"n{k:05d}", texts[k % 300] if k % 3 else texts[0]) for k in range(3000)] + [("z", None), (None, "w1"), ("y", "")]
    docs = spark.createDataFrame(rows, "id string, t string").repartition(6)
    queries = spark.createDataFrame([(q, " ".join(rng.sample(words[:12], 6))) for q in range(20)] + [(98, texts[0]), (99, "none"), (100, None)], "q long, t string")
    return docs, queries


@pytest.mark.parametrize("cells", [1 << 20, 100])
def test_ranking_shuffles_no_match_that_its_task_can_drop(spark, corpus, monkeypatch, cells):
    monkeypatch.setattr(lexical, "CELLS", cells)
    monkeypatch.setattr(lexical, "ADDED", cells)
    docs, queries = corpus
    index, k = lexical.build_index(docs, "id", "t"), 7
    got, moved = shuffled(spark, lambda: lexical.bm25_rank(index, queries, k, "q", "t").collect())
    asked = queries.select(F.col("q").alias("query"), F.explode(F.array_distinct(F.split("t", " "))).alias("term"))
    every = lexical._summed(index, asked, index.postings(asked.select("term").distinct()), 1.5, 0.75)
    want = lexical.padded(lexical.first_k(every, k), queries.select(F.col("q").alias("query")), index.first_ids(k), k)
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.withColumn("score", F.round("score", 6)).collect())) and len(got) == 23 * k
    assert every.count() > 30_000 > 8_000 > moved, moved


def test_rankings_by_several_constants_and_beyond_the_limits(spark, corpus, monkeypatch):
    docs, queries = corpus
    index, pairs = lexical.build_index(docs, "id", "t"), [(1.5, 0.75), (0.6, 0.2)]
    both = [sorted(map(tuple, r.collect())) for r in lexical.bm25_ranks(index, queries, 5, "q", "t", pairs)]
    assert both == [sorted(map(tuple, lexical.bm25_rank(index, queries, 5, "q", "t", *c).collect())) for c in pairs] and both[0] != both[1]
    monkeypatch.setattr(lexical, "MOST_QUERIES", 3)
    assert both == [sorted(map(tuple, r.collect())) for r in lexical.bm25_ranks(index, queries, 5, "q", "t", pairs)]


def test_evidence_shuffles_no_terms_of_spans(spark):
    rng = random.Random(3)
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(4000)]
    lines = lambda n: "\n".join(" ".join(rng.choices(words, k=20)) for _ in range(n))
    jobs = spark.createDataFrame([(str(k), "f", "c", "t", lines(40)) for k in range(60)], "id string, job_family string, company string, title string, description_clean string").repartition(4)
    nodes = chunks.passages(jobs, "id", "description_clean").withColumnRenamed("id", "job_id")
    nodes = evidence.written(nodes, "nodes")
    rows, moved = shuffled(spark, lambda: evidence.evidence_rows(jobs, nodes).collect())
    spans = len(rows)
    assert spans == 2400 and sum(r["reason"] is None for r in rows) > 1500 and all(r["node_ids"] and len(r["distinctive_terms"]) > 10 for r in rows if r["reason"] is None)
    # texts, passages, terms of the corpus by task, and a digest of each span; once each, the 20 terms and 11 levels of a span not
    assert moved < 2 * spans + 60 + nodes.count() + 4 * len(words) + 100, moved


@pytest.mark.parametrize("seed", range(5))
def test_passages_around_a_span_are_those_of_a_plain_loop(seed):
    rng = random.Random(seed)
    nodes = [{"node_id": f"n{k}", "start_offset": (a := rng.randrange(90)), "end_offset": a + rng.choice([-1, 0, 5, 30, 80]), "canonical_section": rng.choice([None, "", "a"]), "section_heading": rng.choice([None, "H"])} for k in range(60)]
    nodes += [nodes[0] | {"start_offset": None}, nodes[1] | {"end_offset": None}]
    made = evidence.Passages(nodes)
    for _ in range(200):
        a = rng.randrange(100)
        b = a + rng.randrange(20)
        want = [n for n in nodes if None not in (n["start_offset"], n["end_offset"]) and n["start_offset"] <= a and n["end_offset"] >= b]
        assert sorted(n["node_id"] for n in made.around(a, b)) == sorted(n["node_id"] for n in want)


def test_batches_of_texts_to_python_are_bounded(spark, monkeypatch):
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([("a", "x y", "c")], "id string, t string, c string")
    made = (
        lambda: chunks.chunks(docs, "id", "t"), lambda: chunks.passages(docs, "id", "t"), lambda: evidence.evidence_spans(docs, id_col="id", text_col="t", company_col="c"),
        lambda: evaluate.short_links(docs.selectExpr("id AS node", "t AS text"), docs.selectExpr("id AS query", "t AS item")),
    )
    for make in made:
        spark.conf.set(rows, "10000")
        spark.conf.set(size, str(1 << 30))
        make()
        assert int(spark.conf.get(rows)) <= batches.BATCH_ROWS and int(spark.conf.get(size)) <= batches.BATCH_BYTES


def test_a_kept_index_shuffles_no_blocks_and_no_matches(spark, corpus, monkeypatch, tmp_path):
    monkeypatch.setattr(kept_index, "RANGE", 32)
    monkeypatch.setattr(kept_index, "FIRST", 1)
    docs, queries = corpus
    docs.write.parquet(str(tmp_path / "docs"))
    index, building = shuffled(spark, lambda: kept_index.kept_index(spark.read.parquet(str(tmp_path / "docs")), "id", "t"))
    (ranked, _), searching = shuffled(spark, lambda: kept_index.search(index, queries, 5, "q", "t"))
    got, last = shuffled(spark, ranked.collect)
    want = lexical.bm25_topk(docs, queries, 5, "id", "t", "q", "t")
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect()))
    assert index.bounds.count() > 2000 and building < 2 * 3003 + 500, building  # documents once, beside their lengths and the check of their ids
    assert searching + last < 12_000, (searching, last)
    monkeypatch.setattr(kept_index, "MOST_QUERIES", 6)
    monkeypatch.setattr(kept_index, "HELD", 10)
    again, counts = kept_index.search(index, queries, 5, "q", "t")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got)) and counts.count() == 21


def test_links_of_items_shuffle_no_texts_and_no_windows(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(800)]
    items = [(q, " ".join(texts[q * 7].split()[9 : 9 + rng.choice([1, 3, 4, 12])])) for q in range(60)]
    docs, asked = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, t string"), spark.createDataFrame(items, "q long, t string")
    want = sorted((q, k) for q, i in items for k, t in enumerate(texts) if i in t)
    got, moved = shuffled(spark, lambda: evaluate.containment_qrels(docs, asked, "id", "t", "q", "t").collect())
    assert sorted(map(tuple, got)) == want
    assert moved < len(want) + 2 * len(items) + 50, moved
    for name, value in (("MACHINE_CHARS", 300), ("MOST_PASSES", 0)):  # several passes, and windows of words beyond them
        monkeypatch.setattr(evaluate, name, value)
        assert sorted(map(tuple, evaluate.containment_qrels(docs, asked, "id", "t", "q", "t").collect())) == want


def test_a_ranking_reads_all_tokens_once(spark, corpus, monkeypatch):
    docs, queries = corpus
    index, read = lexical.build_index(docs, "id", "t"), spark.sparkContext.accumulator(0)
    counted = F.udf(lambda tokens: read.add(1) or tokens, "array<string>")
    index = lexical.Index(index.tokens.withColumn("tokens", counted("tokens")), index.n_docs, index.mean_length)
    assert lexical.bm25_rank(index, queries, 5, "q", "t").count() == 23 * 5 and read.value == index.n_docs, read.value


def test_failure_cases_shuffle_no_passages(spark, monkeypatch):
    nodes = spark.createDataFrame([(f"n{k}", f"j{k % 9}", "t", "c", None, f"text {k}") for k in range(3000)], "node_id string, job_id string, title string, company string, section_heading string, content_text string")
    queries = spark.createDataFrame([(f"q{k}", f"p{k}", evaluate.KINDS[k % 2], "asked", f"j{k % 9}", "text") for k in range(30)], "query_id string, pair_id string, query_type string, query string, source_job_id string, evidence_text string")
    results = spark.createDataFrame([(f"q{k}", m, [f"n{k * 50 + i}" for i in range(20)]) for k in range(30) for m in evaluate.METHODS], "query_id string, method string, ranked_node_ids array<string>")
    scores = spark.createDataFrame([(f"q{k}", m, 0, ["n7"]) for k in range(30) for m in evaluate.METHODS], "query_id string, method string, source_evidence_hit_at_5 long, evidence_node_ids array<string>")
    got, moved = shuffled(spark, lambda: report.failure_cases(results, scores, queries, nodes, 4).collect())
    assert len(got) == 12 and all([t["excerpt"] for t in r["top5"]] == [f"text {int(r['query_id'][1:]) * 50 + i}" for i in range(5)] for r in got)
    assert moved < 3000, moved


def test_coverage_finds_its_gold_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ranking, "_rankings", lambda *a: None)
    monkeypatch.setattr(evaluate, "candidate_coverage", lambda ranked, gold, asked: seen.append(gold))
    ranking.candidate_coverage(spark, SF)
    assert "MapInArrow" not in (plan := seen[0]._jdf.queryExecution().executedPlan().toString()) and "documents" not in plan


def test_reranking_shuffles_tokens_of_candidates_only(spark, monkeypatch):
    index = lexical.build_index(spark.createDataFrame([(k, f"some{k % 7} words{k % 11}") for k in range(20_000)], "id long, t string"), "id", "t")
    monkeypatch.setattr(ranking, "_index", lambda *a: index)
    listed = spark.createDataFrame([(m, f"{q}_{e}", 10 * q + n, n + 1) for m in ("bm25", "dense") for q in range(40) for e in ("high", "low") for n in range(10)], "method string, query string, node long, rank long")
    monkeypatch.setattr(ranking, "_rankings", lambda *a: listed)
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        got, moved = shuffled(spark, lambda: ranking.rerank_standin(spark, SF).collect())
    finally:
        spark.conf.set(limit, before)
    assert len(got) == 800 and moved < 10_000, moved  # some times the candidates
