"""The registered queries themselves over small Parquet tables: columns, types, folds, thresholds, digests, SQL."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestack.llm import bpe, catalog, chat, common, warc

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_toxicity": ["doc_id bigint", "held_out boolean", "score double", "predicted int"],
    "op2_exact_dedup": ["doc_id bigint", "keep_id bigint", "group_size bigint", "kept boolean", "text_sha256 string"],
    "op3_packing": ["doc_id bigint", "start bigint", "length bigint", "ids_crc32 bigint", "doc_tokens bigint", "sequence_id bigint", "offset bigint"],
    "op4_bpe": ["doc_id bigint", "n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"],
    "op5_warc": ["page_id bigint", "payload_bytes bigint", "payload_digest string", "record_type string", "refers_to bigint"],
    "op6_chat": ["conv_id bigint", "n_turns bigint", "turns_sha256 string", "loss_chars bigint", "loss_sha256 string", "formatted_chars bigint"],
    "op7_language": ["doc_id bigint", "held_out boolean", "lang_pred string", "score double"],
    "op8_quality": ["doc_id bigint", "held_out boolean", "score double", "predicted int"],
    "op9_media": ["doc_id bigint", "n_bytes bigint", "payload_bytes bigint", "payload_sha256 string", "tail_crc32 bigint", "media_bytes bigint", "media_sha256 string", "feature string"],
    "op10_ngram_join": ["doc_id bigint", "n_shingles bigint", "component_id bigint"],
    "op11_repair": ["conv_id bigint", "gaps bigint", "blank bigint", "duplicate bigint", "truncated bigint", "illegal bigint", "cost bigint", "audit string", "repaired_sha256 string"],
    "op12_quality_rules": ["doc_id bigint", "n_words bigint", "word_chars bigint", "n_symbols bigint", "n_dup_lines bigint", "n_repeat_words bigint", "base_failed boolean", "kept boolean"],
    "op13_filter_audit": ["part string", "filter_order string", "step int", "kept bigint", "removed bigint", "redundant bigint", "unique_fails bigint", "good_lost bigint", "toxic_lost bigint", "shapley bigint"],
}


@pytest.fixture(scope="module")
def found(spark):
    """The rows of each query, asked once."""
    made = {}

    def rows(name):
        if name not in made:
            df = catalog.queries()[name](spark, SF)
            assert [f"{c} {kind}" for c, kind in df.dtypes][: len(COLUMNS[name])] == COLUMNS[name]
            made[name] = df.collect()
        return made[name]

    return rows


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall())


def test_every_operator_is_registered():
    assert list(catalog.queries()) == list(COLUMNS)


@pytest.mark.parametrize("name, folds, rest, least", [("op1_toxicity", 5, 0, 0.5), ("op8_quality", 4, 2, 0.7)])
def test_scores(found, texts, name, folds, rest, least):
    rows = found(name)
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == rest) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= least)


def test_languages(found, texts):
    langs = {x for (x,) in duckdb.sql(f"SELECT DISTINCT lang FROM '{SF}/documents.parquet' WHERE lang IS NOT NULL").fetchall()}
    for r in found("op7_language"):
        letters = any(c.isalpha() for c in texts[r["doc_id"]])
        assert r["lang_pred"] in (langs if letters else {"und"}) and 0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_queries_equal_their_sql(found, name):
    db = duckdb.connect()
    for table in ("documents", "pages", "labels", "conversations"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = db.sql(catalog.oracle_sql()[name])
    names = [c.split()[0] for c in COLUMNS[name]]
    assert sorted(want.columns) == sorted(names)
    order = [want.columns.index(c) for c in names]
    assert sorted((tuple(r[k] for k in order) for r in want.fetchall()), key=repr) == sorted((tuple(r) for r in found(name)), key=repr)


def test_tokens_and_packing(found, texts):
    library = Tokenizer.from_file(bpe.default_vocabulary())
    library.no_truncation(), library.no_padding()
    ids = {k: library.encode(t, add_special_tokens=False).ids for k, t in texts.items()}
    raw = lambda x: b"".join(i.to_bytes(4, "little") for i in x)
    assert {r["doc_id"]: tuple(r)[1:4] for r in found("op4_bpe")} == {k: (len(x), hashlib.sha256(raw(x)).hexdigest(), hashlib.sha256(library.decode(x, skip_special_tokens=False).encode()).hexdigest()) for k, x in ids.items()}
    pieces, sequences = {}, {}
    for r in found("op3_packing"):
        whole = [*ids[r["doc_id"]], 1]
        part = whole[r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] > 0 and r["ids_crc32"] == zlib.crc32(raw(part)) and r["doc_tokens"] == len(whole)
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts, total in [*((sorted(p), len(ids[k]) + 1) for k, p in pieces.items()), *((sorted(s), None) for s in sequences.values())]:
        at = 0
        for start, length in parts:
            assert start == at
            at += length
        assert at == total or (total is None and at <= 2048)
    assert set(pieces) == set(texts) and sum(sum(n for _, n in s) == 2048 for s in sequences.values()) >= len(sequences) - 1


def test_chats(found):
    rows = {}
    for conv, role, text in duckdb.sql(f"SELECT conv_id, role, coalesce(text, '') FROM '{SF}/conversations.parquet' ORDER BY conv_id, turn").fetchall():
        rows.setdefault(conv, []).append((role, text))
    rows[-1] = [("user", chat.PROBE), ("assistant", chat.PROBE)]
    assert {r["conv_id"] for r in found("op6_chat")} == set(rows)
    for r in found("op6_chat"):
        turns = rows[r["conv_id"]]
        said = "".join(t for role, t in turns if role == "assistant")
        assert tuple(r)[1:5] == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
        assert r["formatted_chars"] > sum(len(t) for _, t in turns)


def test_media(found, texts):
    for r in found("op9_media"):
        raw = texts[r["doc_id"]].encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert tuple(r)[1:5] == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])) and r["media_bytes"] > 0 and r["feature"]


def test_joined_classes(found, texts):
    sets = {}
    for k, t in texts.items():
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c.lower() if "A" <= c <= "Z" else c for c in t).split(" ") if w]
        sets[k] = {tuple(words[i : i + 4]) for i in range(len(words) - 3)} or ({tuple(words)} if words else set())
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found("op10_ngram_join")} == {k: (len(s), top(k)) for k, s in sets.items()}


def test_base_rules(found, texts):
    for r in found("op12_quality_rules"):
        words = texts[r["doc_id"]].encode().split()
        assert r["n_words"] == len(words) and r["word_chars"] == sum(len(w.decode()) for w in words)
        assert not (r["kept"] and (r["base_failed"] or r["n_words"] < 50))


def test_a_long_system_turn_is_written_once(spark):
    """The judge's case: a system turn of 3000 tokens before 200 short turns."""
    rows = [(1, 0, "system", "rule " * 3000), *((1, k, ("assistant", "user")[k % 2], f"short turn {k}") for k in range(1, 201))]
    rows += [(2, 0, "system", "rule " * 300), *((2, k, ("assistant", "user")[k % 2], "longer turn " * 100) for k in range(1, 51))]
    windows = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = {r["conv_id"]: r["n"] for r in windows.groupBy("conv_id").agg(F.sum(F.length("text")).alias("n")).collect()}
    for conv in (1, 2):
        plain = sum(len(t) for c, _, _, t in rows if c == conv)
        assert found[conv] < (2 if conv == 1 else 5) * plain
    assert windows.where("conv_id = 1 AND window > 0").agg(F.max("n_tokens")).first()[0] <= chat.BUDGET
    told = {r["conv_id"]: r["n_turns"] for r in chat.digest_chats(windows).collect()}
    assert told == {1: 201, 2: 51}


def test_archives_of_lost_attempts_are_not_read(spark):
    """A task that ran again on rows in another order, and left its first archives behind."""
    pages = spark.createDataFrame([(k, "u", f"page {k} " + "words of it " * 3000) for k in range(80)], "page_id long, url string, html string")
    folder = common.new_path(spark, "warc-test")
    first = warc.write_warc(pages.coalesce(1), folder, archive_bytes=1 << 12)
    again = warc.write_warc(pages.orderBy(F.desc("page_id")).coalesce(1), folder, archive_bytes=1 << 30)
    assert first.count() > again.count() >= 1
    for listed in (first, again):
        assert sorted(int(r["key"]) for r in warc.read_warc(spark, folder, listed).collect()) == list(range(80))
    assert warc.read_warc(spark, folder).count() == 160


def test_a_payload_larger_than_an_archive(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 3_000_000), (2, "u", "é" * 2_000_000), (3, "u", "x" * 3_000_000)], "page_id long, url string, html string")
    folder = common.new_path(spark, "warc-test")
    listed = warc.write_warc(pages.coalesce(1), folder, archive_bytes=1 << 10)
    got = {int(r["key"]): (r["record_type"], r["payload_bytes"], r["refers_to"]) for r in warc.read_warc(spark, folder, listed).collect()}
    assert got == {1: ("revisit", 3_000_000, "3"), 2: ("response", 4_000_000, None), 3: ("response", 3_000_000, None)}
