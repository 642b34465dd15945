import hashlib
import re

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lodestack.llm import bpe, components, exact_dedup, language, media, ngram_join, packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string"
TEXTS = [None, "", "a b  c", "a b\tc", "Hello, WORLD! naïve cafés 12345", "x" * 3000, "<|endoftext|> it's", " ".join(f"w{i}" for i in range(5000)), "日本語 текст"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, None, None, "clash") for i, t in enumerate(TEXTS)], SCHEMA)


def library():
    made = Tokenizer.from_file(bpe.default_vocabulary())
    made.no_truncation()
    made.no_padding()
    return made


def test_encoding_equals_the_library(docs):
    made = library()
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in bpe.encode_documents(docs).collect()}
    assert got == {i: made.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}


def test_packing_is_gapless_and_whole(docs):
    pieces = packing.pack(docs).collect()
    made = library()
    for i, t in enumerate(TEXTS):
        mine = sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"])
        assert np.concatenate([np.frombuffer(p["ids"], "<u4") for p in mine]).tolist() == [*made.encode(t or "", add_special_tokens=False).ids, 1]
    by = {}
    for p in pieces:
        by.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    assert packing.pack(docs.limit(0)).count() == 0


def test_exact_dedup_against_a_dictionary(docs):
    rows = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs).collect()}
    assert {i: r["keep_id"] for i, r in rows.items()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8}
    assert rows[0]["text_sha256"] == hashlib.sha256(b"").hexdigest() and rows[1]["group_size"] == 2
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 4, 5, 6, 7, 8]
    assert exact_dedup.drop_copies(docs.limit(0)).count() == 0


def test_ngram_components_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 400, 80)) for _ in range(12)]
    texts = []
    for t in base:
        words = t.split()
        texts += [t, " ".join([*words[:-2], "new"]), " ".join([*words[:40], "mid", *words[40:]]), " ".join(words[:60])]
    texts += [None, "", "a b", "A  b"]
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    least = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    least[i] = least[j] = min(least[i], least[j])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(df).collect()} == dict(enumerate(least))


def test_ngram_components_link_isolated_pairs_of_unlike_size(spark):
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(4000):
        size = int(rng.integers(34, 71))
        words = [f"w{x}" for x in rng.integers(0, 10**9, size * 100 // 85 + 3)]
        texts += [" ".join(words[: size + 3]), " ".join(words)]
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in (t.split() for t in texts)]
    owners = {}
    for i, s in enumerate(sets):
        for x in s:
            owners.setdefault(x, set()).add(i)
    pairs = {(min(o), max(o)) for o in owners.values() if len(o) > 1}
    linked = {b: a for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert all(len(o) <= 2 for o in owners.values()) and linked == {2 * k + 1: 2 * k for k in range(4000)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(df, n=4, num=85).collect()}
    assert got == {i: linked.get(i, i) for i in range(len(texts))}


def test_long_runs_of_letters_are_read_whole():
    rng = np.random.default_rng(2)
    same, end = "x" * 24, "zzzz"

    def clause(letters):
        return same + "".join(rng.choice(list(letters), 40)) + end

    def text(letters):
        return "\u3002".join(clause(letters) for _ in range(6))

    crf = language.fit([(text(letters), name) for _ in range(80) for letters, name in (("abcd", "one"), ("efgh", "two"))])
    got = language.Scorer(crf).score([text("abcd"), text("efgh"), clause("abcd"), clause("efgh"), same + "abcd" * 50_000 + end, same + "efgh" * 50_000 + end])
    assert [lang for lang, _ in got] == ["one", "two"] * 3
    assert min(score for _, score in got) > 0.9


def test_language_stage_keeps_certain_words_of_mixed_languages(spark):
    rng = np.random.default_rng(4)
    letters = {"de": "abcd", "en": "efgh", "fr": "ijkl"}

    def words(lang, n):
        return ["".join(rng.choice(list(letters[lang]), 6)) for _ in range(n)]

    rows = [(i, " ".join(words(lang, 60)), lang) for i, lang in enumerate(list(letters) * 100)]
    mixed = [" ".join(words("de", 40) + words("en", 30) + words("fr", 30)), " ".join(words("de", 50) + words("fr", 50)), "123 !", None, ""]
    docs = spark.createDataFrame([*rows, *((1000 + i, t, None) for i, t in enumerate(mixed))], "doc_id long, text string, lang string")
    kept = corpus_pipeline.language_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(300), 1000, 1001]


def test_ngram_components_of_repeated_rows(spark):
    rng = np.random.default_rng(6)
    first, second, want = [], [], []
    for k in range(40):
        words = [f"w{x}" for x in rng.integers(0, 10**9, 80)]
        row, other = (2 * k, " ".join(words)), (2 * k + 1, " ".join([*words, "more"]))
        first.append(row)
        second += [row, other]
        want += [(2 * k, 2 * k)] * 2 + [(2 * k + 1, 2 * k)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(first, 1).union(spark.sparkContext.parallelize(second, 1)), "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in ngram_join.ngram_components(df).collect()) == want


def test_media_codecs_and_stored_pcm(spark):
    codes = bytes(range(256))
    law, rate = media.decode(media.wave(media.A_LAW, 8000, codes))
    assert rate == 8000 and [law[0xD5], law[0x55], law[0xAA], law[0x2A]] == [8, -8, 32256, -32256] and len(set(law.tolist())) == 256
    tone = (8000 * np.sin(np.arange(3000) / 20)).astype(np.int16)
    packed = media.wave(media.IMA_ADPCM, 8000, media.encode_adpcm(tone), 256, 4, len(tone), 505)
    back, _ = media.decode(packed)
    assert len(back) == len(tone) and np.abs(back[200:505].astype(int) - tone[200:505]).max() < 1500
    files = [media.store_bytes(b"abc"), media.store_bytes(codes, media.A_LAW), packed, None]
    df = spark.createDataFrame(list(enumerate(files)), "doc_id long, media binary")
    got = {r["doc_id"]: r["media"] for r in media.decoded_column(df).collect()}
    assert got[3] is None
    for i, raw in enumerate(files[:3]):
        samples, source = media.decode(raw)
        stored, target = media.decode(bytes(got[i]))
        assert target == 16000 and stored.tolist() == media.resample(samples, source, 16000).tolist()


def components_by_brute_force(texts, n, num):
    """The least index of each text's component, by a matrix of all shingles."""
    shingles = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        shingles.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    names = {x: k for k, x in enumerate({x for s in shingles for x in s})}
    matrix = np.zeros((len(texts), len(names)), np.float32)
    for i, s in enumerate(shingles):
        matrix[i, [names[x] for x in s]] = 1
    size, common = matrix.sum(1), matrix @ matrix.T
    linked = (common > 0) & (100 * common >= num * (size[:, None] + size[None, :] - common))
    least = np.arange(len(texts))
    while True:
        now = np.where(linked, least[None, :], len(texts)).min(1).clip(max=least)
        if (now == least).all():
            return [len(s) for s in shingles], least.tolist()
        least = now


@pytest.mark.parametrize("slack", [7.0, 0.0])
def test_ngram_components_at_the_registered_rule(spark, slack):
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 110)]
    line = " ".join(f"line{x}" for x in range(12))
    texts = [" ".join(base)] * 40
    for _ in range(900):
        words = list(base)
        for k in rng.integers(0, len(words), rng.integers(0, 7)):
            words[k] = f"e{rng.integers(0, 10**6)}"
        texts.append(" ".join(words))
    for _ in range(250):
        texts.append(line + " " + " ".join(f"v{x}" for x in rng.integers(0, 10**6, rng.integers(1, 60))))
    for size in (1, 2, 3, 4, 5, 6, 2500):
        words = [f"z{x}" for x in rng.integers(0, 10**6, size)]
        texts += [" ".join(words), "\t".join(words).upper(), " ".join([*words, "one"])]
    texts += [None, "", " \n", "line1 line2", "é é"]
    order = rng.permutation(len(texts))
    texts = [texts[k] for k in order]
    sizes, want = components_by_brute_force(texts, 4, 85)
    assert max(np.bincount(want)) > 200 and len(set(want)) > 400
    df = spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in enumerate(texts)], "doc_id long, text string, cls string, token int, gid int, found string").repartition(12)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(df, n=4, num=85, slack=slack).collect()}
    assert got == {i: (sizes[i], want[i]) for i in range(len(texts))}


def test_ngram_components_defined_cases(spark):
    assert ngram_join.ngram_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "a b c d e f"), (1, "q r s t u v"), (2, "a b c d e f"), (3, "q r s t u v"), (None, "a b c d e f"), (None, "only here five words now"), (4, None)]
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r["doc_id"], r["component_id"]) for r in got.collect()), key=str) == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (None, 1), (None, None), (4, 4)], key=str)


@pytest.mark.parametrize("few", [components.FEW_EDGES, 0])
def test_components_against_a_loop(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW_EDGES", few)
    rng = np.random.default_rng(7)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 40)] + [(500, 500), (9, 8), (9, 8)] + [(int(a), int(b)) for a, b in rng.integers(1000, 1400, (150, 2))]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    assert {r["node"]: r["label"] for r in components.connected(df, []).collect()} == label
    assert components.connected(df.limit(0), []).count() == 0


@pytest.mark.parametrize("most", [ngram_join._BROADCAST_ROWS, 0])
def test_classes_by_broadcast_and_by_shuffle(spark, monkeypatch, most):
    monkeypatch.setattr(ngram_join, "_BROADCAST_ROWS", most)
    monkeypatch.setattr(ngram_join, "_COMMON_ROWS", 20)
    monkeypatch.setattr(ngram_join, "_COMMON_CLASSES", 4)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words)] * 90 + [" ".join([*words, "more"])] * 3 + [" ".join(f"z{i}x{k}" for k in range(20)) for i in range(30)] * 2 + [None, "", "one"]
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in ngram_join.ngram_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sizes, want = components_by_brute_force(texts, 5, 80)
    assert got == {i: (want[i], want[i] == i) for i in range(len(texts))} and len(sizes) == len(got)
