"""Markup, headings, passages, spans and evidence on fixtures and against plain loops."""

import datetime as dt
import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from lodestack.functions import html, text
from lodestack.operators import chunks, evidence, headings
from lodestack.sources.settings import load_heading_types

TYPES = load_heading_types()


@pytest.mark.parametrize(
    "raw, want",
    [
        ("<h2>Role</h2><ul><li>A</li><li>B<ol><li>x</li><li>y</li></ol></li></ul><script>z</script><p>T&amp;C</p>", "## Role\n- A\n- B\n  1. x\n  2. y\nT&C"),
        (None, ""), ("", ""), ("  a \t b\n\n\n\n c \n", "a b\n\nc"), ("&lt;p&gt;one&lt;/p&gt;two", "one\ntwo"), ("&amp;lt;p&amp;gt;x &amp;lt;b&amp;gt;y&amp;lt;/b&amp;gt;", "x y"),
        ("5 < 6 & 7", "5 < 6 & 7"), ("a<br>b<td>c</td>d", "a\nb\nc\nd"), ("<style>a{}</style><script>if(x<1){}</script>end", "end"), ("</ul><li>x</li>", "- x"),
    ],
)
def test_clean(raw, want):
    assert html.clean(raw) == want


def test_clean_column(spark):
    df = spark.createDataFrame([(1, "<p>a</p>b"), (2, None)], "id long, html string")
    assert [r[0] for r in df.select(html.clean_html(F.col("html"))).collect()] == ["a\nb", ""]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("<p><b>Skills</b></p><ul><li>x</li></ul>tail<div>more</div>", [("paragraph", "Skills", 0, True), ("bullet", "x", 0, False), ("paragraph", "tailmore", 0, False)]),
        ("<p><strong>- item</strong></p><h3>H<b>x</b></h3>", [("bullet", "item", 0, True), ("heading", "Hx", 3, False)]),
        ("# Top\n- a\nplain", [("heading", "Top", 1, False), ("bullet", "a", 0, False), ("paragraph", "plain", 0, False)]),
        ("&lt;p&gt;a&lt;br&gt;b&lt;/p&gt;", [("paragraph", "a b", 0, False)]),
        (None, []),
    ],
)
def test_blocks(raw, want):
    assert [(b.kind, b.text, b.level, b.bold) for b in html.blocks(raw)] == want


@pytest.mark.parametrize(
    "heading, want",
    [
        ("## Requirements:", "qualifications"), ("About Acme", "about_company"), ("About the team", None), ("What you’ll do", "responsibilities"), ("What You&#39;ll Bring –", "qualifications"),
        ("ＢＥＮＥＦＩＴＳ", "benefits"), ("Nice to have", "preferred_qualifications"), ("Tech stack:", None), ("", None),
    ],
)
def test_heading_kinds(spark, heading, want):
    assert headings.HeadingTypes(TYPES).kind(heading) == want
    assert spark.createDataFrame([(heading,)], "h string").select(headings.heading_kind(F.col("h"), TYPES)).first()[0] == want


@pytest.mark.parametrize(
    "line, want",
    [
        ("# A heading ##", ("A heading", "unmapped")), ("- Benefits", None), ("1. Benefits", None), ("    # code", None), ("Tech stack:", ("Tech stack:", "unmapped")), ("see http://x.y:", None),
        ("ALL CAPS HERE", ("ALL CAPS HERE", "unmapped")), ("CAPS", None), ("ALL CAPS.", None), ("A sentence.", None), ("x" * 121, None), ("benefits", ("benefits", "benefits")), ("", None), ("#", None),
        (" ".join(["word"] * 13) + ":", None),
    ],
)
def test_heading_lines(line, want):
    assert headings.heading_of(line, headings.HeadingTypes(TYPES)) == want


def test_sections():
    whole = "Intro line\n\n## Requirements\n- Python\nBENEFITS AND PERKS\nfree lunch"
    got = list(headings.section_ranges(whole, headings.HeadingTypes(TYPES)))
    assert got == [(0, 12, None, "unsectioned"), (12, 37, "Requirements", "qualifications"), (37, 66, "BENEFITS AND PERKS", "unmapped")]
    assert list(headings.section_ranges("", headings.HeadingTypes(TYPES))) == []


def test_html_sections(spark):
    raw = "<p>Before it</p><h2>Requirements</h2><ul><li>Python skills</li><li>SQL</li></ul><p><b>Our way</b></p><p>We walk.</p>"
    df = spark.createDataFrame([(1, raw), (2, None), (3, "only words")], "page_id long, html string")
    found = headings.html_sections(df, "page_id", "html", TYPES)
    rows = [tuple(r) for r in found.orderBy("page_id", "section_index").collect()]
    assert rows[0] == (1, 0, "Requirements", "qualifications", 2, "Python skills\nSQL", 3, 2, 2)
    assert rows[1] == (1, 1, "Our way", None, 2, "We walk.", 2, 0, 2)
    assert rows[2][1] == rows[3][1] == -1 and rows[2][-1] == 0 and rows[3][-1] == 2
    stats = {r["page_id"]: r for r in headings.structure_stats(found, "page_id").collect()}
    assert (stats[1]["sections"], stats[1]["typed_sections"], stats[1]["words"], stats[1]["bullets"]) == (2, 1, 5, 2) and stats[2]["sections"] == 0


@pytest.mark.parametrize(
    "whole, size, overlap, want",
    [
        ("alpha beta gamma delta epsilon zeta eta theta", 20, 6, [(0, 17), (11, 31), (23, 40), (31, 45)]),
        ("x" * 25, 10, 3, [(0, 10), (7, 17), (14, 24), (21, 25)]), ("", 10, 3, []), ("a bcdefghijklmnop", 10, 0, [(0, 10), (10, 17)]),
        ("one two\n\nthree four", 12, 0, [(0, 9), (9, 19)]),
    ],
)
def test_chunk_ranges(whole, size, overlap, want):
    assert chunks.chunk_ranges(whole, size, overlap) == want


@pytest.mark.parametrize("size, overlap", [(10, 10), (0, 0), (True, 0), (10, -1), (10.0, 1), (10, True)])
def test_chunk_sizes_are_checked(size, overlap):
    with pytest.raises(ValueError):
        chunks.chunk_ranges("x", size, overlap)


def test_passages_cover_and_name_their_text(spark):
    whole = "Intro words here.\n\n## Requirements\n" + "Know Python well. " * 90 + "\nBENEFITS AND PERKS\n😀 free lunch"
    df = spark.createDataFrame([("j1", whole, "f"), ("j2", None, "f"), ("j3", "", "f")], "id string, description_clean string, job_family string")
    rows = chunks.passages(df, "id", "description_clean", TYPES, 200, 40, keep=["job_family"]).orderBy("start_offset").collect()
    assert {r["id"] for r in rows} == {"j1"} and rows[0]["section_heading"] is None and rows[0]["retrieval_text"] == rows[0]["content_text"]
    at = 0
    for r in rows:
        assert r["start_offset"] <= at and r["content_text"] == whole[r["start_offset"] : r["end_offset"]] and r["end_offset"] - r["start_offset"] <= 200
        assert r["node_id"] == hashlib.sha256(json.dumps(["jd_v2_node_v1", "j1", r["start_offset"], r["end_offset"], r["content_text"]], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
        at = r["end_offset"]
    assert at == len(whole) and [r["chunk_index"] for r in rows if r["section_heading"] == "Requirements"] == list(range(sum(r["section_heading"] == "Requirements" for r in rows)))
    assert rows[-1]["retrieval_text"].startswith("Section: BENEFITS AND PERKS\n")


def test_node_ids(spark):
    want = "3b8df848544e1958bacccd28028d6b70f3fb8d21476d479a2dd96f225a887c88"
    assert chunks.node_id("j1", 0, 5, 'a"b\né') == want
    df = spark.createDataFrame([("j1", 0, 5, 'a"b\né')], "s string, a long, b long, t string")
    assert df.select(chunks.node_id_column(F.col("s"), F.col("a"), F.col("b"), F.col("t"))).first()[0] == want
    key = df.select(text.seeded_key(20260927, F.col("s"))).first()[0]
    assert key == "25fa16a796732fa22b5d9dd87b926f68abaf455a3709a99622e2fa9cc2288cd8"


@pytest.mark.parametrize(
    "value, unit, want",
    [
        ("2024-01-02T03:04:05Z", None, dt.datetime(2024, 1, 2, 3, 4, 5, tzinfo=dt.UTC)), ("20240102T030405+0200", None, dt.datetime(2024, 1, 2, 1, 4, 5, tzinfo=dt.UTC)), ("2024-01-02", None, None), ("2024-01-02T03:04:05", None, None), (" ", None, None),
        (None, None, None), (dt.date(2024, 1, 2), None, None), (dt.datetime(2024, 1, 2), None, None), (1.5, "seconds", dt.datetime(1970, 1, 1, 0, 0, 1, 500000, tzinfo=dt.UTC)), (1500, "milliseconds", dt.datetime(1970, 1, 1, 0, 0, 1, 500000, tzinfo=dt.UTC)),
    ],
)
def test_times(value, unit, want):
    assert text.utc_time(value, unit) == want


@pytest.mark.parametrize("value, unit, error", [(True, "seconds", TypeError), ([1], None, TypeError), (1, None, ValueError), (float("inf"), "seconds", ValueError), ("soon", None, ValueError)])
def test_no_times(value, unit, error):
    with pytest.raises(error):
        text.utc_time(value, unit)


def test_text_columns(spark):
    df = spark.createDataFrame([(" a  b\x1cc ", "3+ years, 1,700 users, v2 and 2.5x, 10%", "AWS. (a\\Eb)", 0.1235)], "s string, n string, p string, f double")
    row = df.select(
        text.location("s").alias("l"), text.numbers("n").alias("n"), text.word_count(F.lit("it’s a well-known naïve fact_1")).alias("w"), text.short_text(F.lit("word " * 50), 20).alias("short"),
        text.has_phrase(F.col("p"), F.lit(" aws ")).alias("yes"), text.has_phrase(F.col("p"), F.lit("AW")).alias("no"), text.has_phrase(F.col("p"), F.lit("a\\Eb")).alias("quoted"), text.has_phrase(F.col("p"), F.lit(" ")).alias("blank"),
        text.trimmed_span(F.lit("ab  cd e "), F.lit(2), F.lit(9)).alias("t"), text.trimmed_span(F.lit("a    b"), F.lit(1), F.lit(5)).alias("none"), text.python_round(F.col("f"), 3).alias("r"),
        text.location(F.lit(" ")).alias("nothing"), text.hostname(F.lit("https://u:p@Ex.COM:8080/x")).alias("host"), text.evidence_terms(F.lit("The C++ of node.js and of.")).alias("terms"),
    ).first()
    assert (row["l"], row["n"], row["w"], row["short"]) == ("a b c", ["3", "1", "700", "2", "10"], 5, "word word word word…"[:20])
    assert (row["yes"], row["no"], row["quoted"], row["blank"]) == (True, False, True, False)
    assert tuple(row["t"]) == (4, 8) and row["none"]["start"] == row["none"]["end"]
    assert row["r"] == round(0.1235, 3) and row["nothing"] is None and row["host"] == "ex.com" and row["terms"] == ["c++", "node.js", "of."]


TEXT = """## Heading
- At least 5 years of building Python services on large clusters
•  At least 5 years of building Python services on large clusters
short line
12) We are an equal opportunity employer and value many different kinds of people here
Acme gives every engineer a budget for books and two conferences each year

"""


def test_spans_and_local_gates():
    whole = TEXT + "First sentence has quite a few words in it. Second one starts here! no break. Third?" + " More words follow it." * 20
    spans = list(evidence.local_gates(whole, "Acme", evidence.Limits(max_chars=200)))
    for a, b, span, words, _ in spans:
        assert whole[a:b] == span == span.strip() and words == len(re.findall(r"[A-Za-z][A-Za-z0-9+.#/\-]*", span))
    reasons = [s[4] for s in spans]
    assert reasons[:5] == ["ambiguous_or_duplicate_source_text"] * 2 + ["length_chars", "template_or_non_role_fact", "mentions_source_company"]
    assert spans[5][2] == "First sentence has quite a few words in it." and spans[5][4] is None and spans[6][2].startswith("Second one starts here! no break.") is True
    assert list(evidence.local_gates("", None, evidence.Limits())) == []
    with pytest.raises(ValueError):
        evidence.Limits(min_chars=0)


def test_evidence_of_a_small_corpus(spark):
    fact = "Operate 12 Kafka clusters with strict latency goals for payments traffic"
    shared = "Write clear documents that explain every design choice to other groups"
    rows = [(f"j{k}", "f", "Acme", f"Requirements:\n- {fact} number {'x' * (k + 1)}\nBenefits:\n- Lunch and fruit and coffee for everyone who comes into our office daily\n- {shared}") for k in range(5)]
    rows += [("j5", "g", None, "Responsibilities:\n- Tune 7 search engines for medical archives in three distant places"), ("j6", "g", None, None)]
    rows.append(("j7", "g", None, "Requirements:\n- " + shared))
    jobs = spark.createDataFrame(rows, "id string, job_family string, company string, description_clean string")
    nodes = chunks.passages(jobs, "id", "description_clean", TYPES).withColumnRenamed("id", "job_id")
    found = evidence.evidence_rows(jobs, nodes, evidence.Limits(max_document_frequency=0.5)).cache()
    got = {(r["job"], r["text"]): r for r in found.collect()}
    assert got["j0", rows[0][3].split("\n")[1][2:]]["reason"] is None and got["j5", rows[5][3].split("- ")[1]]["reason"] is None
    assert got["j0", shared]["reason"] == "non_role_section" and got["j7", shared]["reason"] == "generic_corpus_vocabulary"
    accepted = evidence.evidence_candidates(jobs, found).collect()
    assert [r["source_job_id"] for r in accepted] == ["j0", "j1", "j2", "j3", "j4", "j5"]
    for r in accepted:
        whole = dict((x[0], x[3]) for x in rows)[r["source_job_id"]]
        assert whole[r["evidence_start"] : r["evidence_end"]] == r["evidence_text"] and len(r["evidence_node_ids"]) == 1
        key = f"{r['source_job_id']}\x1f{r['evidence_start']}\x1f{r['evidence_end']}\x1f{r['evidence_text']}"
        assert r["candidate_id"] == hashlib.sha256(key.encode()).hexdigest()[:20]
        words = len(re.findall(r"[A-Za-z][A-Za-z0-9+.#/\-]*", r["evidence_text"]))
        assert r["distinctiveness_score"] == round(len(r["distinctive_terms"]) / words**0.5 + 1 + 0.5, 3)
    counts = {r["outcome"]: r["spans"] for r in evidence.evidence_counts(found).collect()}
    assert counts["accepted_candidates"] == 6 and sum(counts.values()) == found.count() and evidence.evidence_rejections(found).count() == sum(counts.values()) - 6


def test_repeated_passages_are_no_evidence(spark):
    line = "Requirements:\n- Handle 30 distinct customs forms for overseas parcels every busy morning"
    jobs = spark.createDataFrame([(f"j{k}", "f", None, line) for k in range(4)] + [(f"k{k}", "f", None, f"Filler text {k}") for k in range(9)], "id string, job_family string, company string, description_clean string")
    nodes = chunks.passages(jobs, "id", "description_clean", TYPES).withColumnRenamed("id", "job_id")
    found = evidence.evidence_rows(jobs, nodes)
    assert {r["reason"] for r in found.where("job LIKE 'j%' AND length(text) > 20").collect()} == {"repeated_across_jobs"}
