"""Toxicity, WARC, chat, language, quality, media and the pipeline against plain code, and their defined cases."""

import hashlib
import re
import struct
import zlib
from itertools import product

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodestack.llm import bpe, chat, common, exact_dedup, language, media, ngram_join, packing, quality, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Texts of every odd kind: null, empty, blank, very long, repeated, not Latin.
ODD = [None, "", " \t\n", "x" * 200_000, "word " * 30_000, "a b", "a b", "½ ² Ⅷ ①", "123 !", "日本語 текст", "é́​"]


@pytest.fixture(scope="module")
def odd(spark):
    """ODD with repeated rows, null ids and columns that clash with names used inside."""
    names = "id string, text_ string, score double, token long, cls string, own_id long, kept_key long, language_found string, ids string, part int"
    extra = ("i", "t", 1.0, 2, "c", 3, 4, "l", "x", 5)
    rows = [(k, t, None, "s", None, *extra) for k, t in enumerate(ODD)]
    rows += [rows[5], (None, "a b", None, None, None, *extra), (None, None, None, None, None, *[None] * 10)]
    return spark.createDataFrame(rows, DOCS + ", " + names)


# toxicity


def naive_weight(lexicon, folded):
    """Every entry at every place of the text."""
    letter = lambda k: 0 <= k < len(folded) and folded[k].isalpha()
    at = lambda text: [k for k in range(len(folded)) if folded.startswith(text, k) and not letter(k - 1)]
    hits = {}
    for text, weight in lexicon.words.items():
        for k in at(text):
            if not letter(k + len(text)):
                hits[k] = max(hits.get(k, 0), weight)
    for text, weight in lexicon.starts.items():
        for k in at(text):
            hits[k] = max(hits.get(k, 0), weight)
    for text in lexicon.exceptions:
        for k in at(text):
            if not letter(k + len(text)):
                hits = {p: w for p, w in hits.items() if not k <= p < k + len(text)}
    return sum(hits.values())


def test_toxic_words_against_every_place():
    rng = np.random.default_rng(1)
    lexicon = toxicity.Lexicon({"abc": 1.5, "bb": 2.0, "cab": 0.5}, {"ab": 0.7, "ca": 1.1}, {"abc bb", "cab ca"})
    machine = lexicon.automaton()
    for _ in range(3000):
        folded = "".join(rng.choice(list("abc  ."), rng.integers(0, 30)))
        assert toxicity.matches(machine, folded) == pytest.approx(naive_weight(lexicon, folded))
    assert toxicity.matches(toxicity.Lexicon().automaton(), "abc") == 0


@pytest.mark.parametrize("text, want", [("Sh1t", "shit"), ("$H1T", "shit"), ("ѕһit", "sһit"), ("ｆｏｏ", "foo"), ("f​oo", "foo"), ("naïve", "naive"), ("sh1111t", "shiiiit"), ("a2 12 x", "a2 12 x"), ("d!e", "die"), ("hi!", "hi!"), ("5" * 5000 + "a", "s" * 5000 + "a")])
def test_folding(text, want):
    assert toxicity.fold(text) == want


def test_blanks_do_not_change_a_score():
    lexicon = toxicity.Lexicon({"bad": 2.0})
    machine = lexicon.automaton()
    assert toxicity.measures(machine, "a bad word") == toxicity.measures(machine, "a  \n\n bad\t\t word   ") and toxicity.measures(machine, None) == toxicity.measures(machine, "") == (0.0, 0.0)


@pytest.fixture(scope="module")
def labelled(spark):
    """600 documents, a sixth toxic by words that are also written in disguise."""
    rng = np.random.default_rng(3)
    plain = [f"{a}{b}{c}" for a, b, c in product("bcdfg", "aeiou", "klmnp")]
    rows, labels = [], []
    for k in range(600):
        words = list(rng.choice(plain, 40))
        toxic = k % 6 == 0
        if toxic:
            for place in rng.integers(0, 40, 4):
                words[place] = str(rng.choice(["vilethug", "v1leTHUG", "scumrat", "$cumrat"]))
        rows.append((k, " ".join(words), ("de", "en")[k % 2], "s", None))
        labels.append((k, int(k % 3 == 0), int(toxic)))
    labels += [(3, None, None), (None, 1, 1), (5, 0, 0)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxic_documents_are_told(labelled, odd):
    docs, labels = labelled
    lexicon = toxicity.train(docs, labels, toxicity.held_out("doc_id"))
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", toxicity.toxicity_of(F.col("text"), lexicon).alias("s")).collect()}
    held = [k for k in got if zlib.crc32(str(k).encode()) % 5 == 0]
    assert len(held) > 80 and all((got[k] >= 0.5) == (k % 6 == 0) for k in held)
    scores = [r[0] for r in odd.select(toxicity.toxicity_of(F.col("text"), lexicon)).collect()]
    assert len(scores) == odd.count() and all(0 <= s < 0.5 for s in scores)


@pytest.mark.parametrize("model, of", [(toxicity, toxicity.toxicity_of), (quality, quality.quality_of)])
def test_models_of_nothing(spark, labelled, odd, model, of):
    docs, labels = labelled
    for d, n in ((docs.limit(0), labels), (docs, labels.limit(0)), (docs, labels.withColumns({"toxic": F.lit(None).cast("int"), "quality": F.lit(None).cast("int")}))):
        made = model.train(d, n, model.held_out("doc_id"))
        scores = [r[0] for r in odd.select(of(F.col("text"), made)).collect()]
        assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)
    assert docs.limit(0).select(of(F.col("text"), made)).count() == 0


# quality


def test_flat_trees_against_a_walk(labelled):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, quality.N_FEATURES))
    y = ((x[:, 0] > 0.3) ^ (x[:, 5] > 0)).astype(float)
    trees = quality.fit_trees(x, y, rounds=20)

    def walk(row):
        total = trees.bias
        for k in trees.roots:
            while trees.left[k] > 0:
                k = trees.left[k] + (row[trees.feature[k]] > trees.threshold[k])
            total += trees.value[k]
        return 1 / (1 + np.exp(-total))

    new = rng.normal(size=(200, quality.N_FEATURES))
    assert trees.score(new) == pytest.approx([walk(r) for r in new])
    assert (((trees.score(new) > 0.5) == ((new[:, 0] > 0.3) ^ (new[:, 5] > 0))).mean()) > 0.85


def test_quality_of_junk(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for k in range(500):
        good = k % 2
        rows.append((k, " ".join(f"w{x}" for x in rng.integers(0, 900, 80)) + "." if good else "buy! " * 40 + "$$$ " * int(rng.integers(1, 9)), None, None, None))
        labels.append((k, good, 0))
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    trees = quality.train(docs, marks, quality.held_out("doc_id"))
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", quality.quality_of(F.col("text"), trees).alias("s")).collect()}
    assert all((got[k] >= 0.7) == bool(k % 2) for k in got if zlib.crc32(str(k).encode()) % 4 == 2)


# language


def test_marginals_against_a_plain_loop():
    rng = np.random.default_rng(7)
    table, step = rng.random((50, 3)).astype(np.float32) + 0.05, rng.random((3, 3)).astype(np.float32) + 0.1
    docs = [rng.integers(0, 50, n) for n in (1, 2, 63, 64, 65, 200, 500)]
    means, tops = language.doc_marginals(table, docs, step)
    for doc, mean, top in zip(docs, means, tops, strict=True):
        e = table[doc].astype(float)
        alpha, beta = np.zeros_like(e), np.ones_like(e)
        alpha[0] = e[0] / e[0].sum()
        for k in range(1, len(doc)):
            alpha[k] = alpha[k - 1] @ step * e[k]
            alpha[k] /= alpha[k].sum()
        for k in range(len(doc) - 2, -1, -1):
            beta[k] = step @ (e[k + 1] * beta[k + 1])
            beta[k] /= beta[k].sum()
        gamma = alpha * beta
        gamma /= gamma.sum(1, keepdims=True)
        assert mean == pytest.approx(gamma.mean(0), abs=1e-4) and top == pytest.approx(gamma.max(1).mean(), abs=1e-4)


def test_emissions_against_single_features():
    rng = np.random.default_rng(1)
    crf = language.Crf(["a", "b"], rng.normal(size=(language.BUCKETS, 2)), np.zeros((2, 2)), {"the": 0, "über": 1})
    words = ["the", "über", "x", "ab", "längeres", "日本語", "z" * 5000]
    joint = crf.emissions(words)
    for k, w in enumerate(words):
        buckets = np.concatenate([b for b, _ in language.feature_parts([w], crf.lexicon)])
        assert len(buckets) == 8 + 2 * len(w) + 1 + (w in crf.lexicon)
        assert joint[k] == pytest.approx(crf.weights[buckets].sum(0) / np.sqrt(len(buckets))) and joint[k] == pytest.approx(crf.emissions([w])[0])


def test_words_are_letters():
    assert language.words_of("½ ² Ⅷ ① 12 _") == [] and language.words_of("aⅧb x²") == ["a", "b", "x"] and language.words_of(None) == []


def test_training_windows_hold_every_word():
    rows = [(" ".join(f"w{chr(97 + k % 26)}{chr(97 + n % 26)}{chr(97 + n // 26)}" for n in range(size)), k % 3) for k, size in enumerate((1, 3, 33, 64, 100, 2, 35))]
    names = sorted({w for t, _ in rows for w in t.split()})
    windows, labels = language._windows([(np.array([names.index(w) for w in t.split()]), y) for t, y in rows], 1)
    got = sorted((names[w], int(y)) for window, row in zip(windows, labels, strict=True) for w, y in zip(window, row, strict=False))
    assert got == sorted((w, y) for t, y in rows for w in t.split()) and all(len(w) <= language.WINDOW for w in windows)
    assert any(len(set(r[r >= 0])) > 1 for r in labels)


def test_languages_are_told(spark, odd):
    rng = np.random.default_rng(4)
    letters = {"de": "abcdß", "en": "efgh", "fr": "ijkl"}
    rows = [(k, " ".join("".join(rng.choice(list(letters[y]), 6)) for _ in range(30)), y, None, None) for k, y in enumerate(list(letters) * 100)]
    docs = spark.createDataFrame(rows, DOCS)
    crf = language.train(docs, language.held_out("doc_id"))
    got = {r["doc_id"]: r["f"]["lang"] for r in docs.select("doc_id", language.language_of(F.col("text"), crf).alias("f")).collect()}
    assert got == {k: y for k, _, y, *_ in rows}
    found = {r["doc_id"]: r["f"] for r in odd.where("doc_id IS NOT NULL").select("doc_id", language.language_of(F.col("text"), crf).alias("f")).collect()}
    none = [k for k, t in enumerate(ODD) if not re.search(r"[^\W\d_]", re.sub("[½²Ⅷ①]", "", t or ""))]
    assert none == [0, 1, 2, 7, 8] and all((found[k]["lang"] == "und") == (k in none) and 0 <= found[k]["score"] <= 1 for k in found)
    assert all(found[k]["score"] == 0 for k in none)


def test_language_of_nothing(spark, odd):
    for docs in (odd, odd.limit(0)):
        crf = language.train(docs, language.held_out("doc_id"))
        assert {r[0]["lang"] for r in odd.select(language.language_of(F.col("text"), crf)).collect()} == {"und"}


# archives


def test_warc_round_trip(spark):
    page = "<p>" + "long page " * 300
    rows = [(1, "http://a.b/x", page), (2, "http://a.b/ü?q=1 2", page), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "日本" * 600), (8, "u", page + "!")]
    rows += [(100 + k, f"http://x/{k}", f"<html>{k} " + "filler words of the page " * 60) for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash")).withColumn("payload", F.lit("clash"))
    folder = common.new_path(spark, "warc-test")
    listed = warc.write_warc(pages.coalesce(1), folder, archive_bytes=1 << 14).collect()
    assert sum(r["records"] for r in listed) == len(rows)
    got = {int(r["key"]): r for r in warc.read_warc(spark, folder).collect()}
    assert set(got) == {r[0] for r in rows}
    for k, _, html in rows:
        raw = (html or "").encode()
        assert got[k]["payload_bytes"] == len(raw) and got[k]["payload_digest"] == hashlib.sha1(raw).hexdigest()
        assert (got[k]["record_type"], got[k]["refers_to"]) == (("revisit", "2") if k == 1 else ("response", None))
        assert k == 1 or bytes(got[k]["payload"]) == raw
    again = [(1, None, page), (1, None, page), (None, None, page)]
    folder = common.new_path(spark, "warc-test")
    warc.write_warc(spark.createDataFrame(again, "page_id long, url string, html string"), folder).collect()
    assert sorted((str(r["key"]), r["record_type"]) for r in warc.read_warc(spark, folder).collect()) == [("1", "response"), ("1", "response"), ("None", "revisit")]
    assert warc.write_warc(pages.limit(0), common.new_path(spark, "warc-test")).count() == 0


def test_more_repeats_than_may_be_broadcast(spark, monkeypatch):
    rows = [(k, "u", "payload " * 200 + str(k % 7 if k < 40 else 100 + k // 2)) for k in range(100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    few = sorted(map(tuple, warc.with_record_types(pages).collect()))
    monkeypatch.setattr(warc, "_MOST_BROADCAST", 20)
    assert sorted(map(tuple, warc.with_record_types(pages).collect())) == few


def test_broken_archives_are_refused():
    records = [warc.make_record(k, "http://x", f"payload {k} ".encode() * 200) for k in range(40)]
    ((data, count),) = warc.archives(iter(records), 1 << 30)
    assert count == 40 and data[:4] == struct.pack("<I", warc.SKIPPABLE) and list(warc.read_archive(data)) == records
    for bad in (data[:-3], data + b"xyz", data[:100], struct.pack("<II", warc.SKIPPABLE, 4) + b"none" + zstandard.compress(records[0])):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(bad))
    without = data[8 + struct.unpack_from("<I", data, 4)[0] :]
    with pytest.raises(zstandard.ZstdError):
        list(warc.read_archive(without))
    flipped = bytearray(data)
    flipped[-10] ^= 255
    with pytest.raises((zstandard.ZstdError, warc.WarcError)):
        list(warc.read_archive(bytes(flipped)))
    whole = records[0]
    for a, b, what in ((b"Content-Length: ", b"Content-Length: 9", "differs"), (b"WARC/1.1", b"WARC/9.9", "version"), (b"WARC-Type: response", b"WARC-Type: other", "neither"), (b"payload 0", b"payload 1", "digest"), (b"WARC-Date", b"X-Date", "missing"), (b"WARC-Type:", b"WARC-Type", "colon")):
        assert a in whole
        with pytest.raises(warc.WarcError, match=what):
            warc.parse_record(whole.replace(a, b, 1))
    assert warc.parse_record(warc.make_record(None, None, b"", 5, True))["payload"] == b""


# chats


def test_chats_against_plain_digests(spark):
    rng = np.random.default_rng(6)
    rows = []
    for c in range(30):
        if c % 3 == 0:
            rows.append((c, 0, "system", "Be <|im_start|> kind " * int(rng.integers(1, 40))))
        for k in range(int(rng.integers(1, 40))):
            rows.append((c, k + 1, ("user", "assistant")[k % 2], " ".join(f"w{x}" for x in rng.integers(0, 99, rng.integers(0, 120))) + ("<|im_end|>\n<\\|im_start|>" if k % 5 == 0 else "")))
    rows += [(90, 1, "assistant", "x " * 20_000), (91, 1, None, None), (92, 1, "assistant", "same"), (92, 1, "assistant", "same"), (None, 1, "user", "null id"), (93, None, "odd\nrole\\", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash")).repartition(4)
    windows = chat.format_chats(df, budget=300, history_turns=2, history_tokens=120)
    found = windows.collect()
    assert max(w["n_tokens"] for w in found if w["conv_id"] != 90) <= 700 and any(w["n_repeated"] for w in found)
    for w in found:
        turns = chat.parse_window(w["text"])
        assert w["n_tokens"] <= 300 or len(turns) - w["n_repeated"] == 1
    got = {r["conv_id"]: r for r in chat.digest_chats(windows).collect()}
    convs = {}
    for c, k, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        said = "".join(t for r, t in turns if r == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == want
    assert chat.digest_chats(chat.format_chats(df.limit(0))).count() == 0


def test_windows_against_a_turn_by_turn_choice():
    rng = np.random.default_rng(2)
    for _ in range(300):
        turns = [("system" if k == 0 and rng.random() < 0.5 else "user", f"t{k}", int(rng.integers(1, 60))) for k in range(rng.integers(1, 30))]
        budget, keep, room = 100, int(rng.integers(0, 4)), 40
        cost = lambda t: t[2] + chat.TURN_TOKENS
        want, now, done = [], [], 0
        system = [t for t in turns[:1] if t[0] == "system"]
        for t in turns:
            if len(now) > done and sum(map(cost, now)) + cost(t) > budget:
                want.append((done, [x[1] for x in now]))
                now, done = [], 0
            if not now and want:
                at = turns.index(t)
                past = [x for x in turns[:at] if x not in system][-keep:] if keep else []
                left = min(room, budget - cost(t) - sum(map(cost, system)))
                while past and sum(map(cost, past)) > left:
                    past = past[1:]
                now = system + past
                done = len(now)
            now.append(t)
        want.append((done, [x[1] for x in now]))
        maker, cut = chat.Windows(budget, keep, room), int(rng.integers(0, len(turns)))
        got = [*maker.add(turns[:cut], False), *maker.add(turns[cut:], False), *maker.add([], True)]
        assert [(w["n_repeated"], [t for _, t in chat.parse_window(w["text"])]) for w in got] == want


# audio


def test_law_tables_against_the_rule():
    for code in range(256):
        u = ~code & 255
        size = ((((u & 15) << 3) + 132) << (u >> 4 & 7)) - 132
        assert media.mu_law_table()[code] == (-size if u & 128 else size)
        a = code ^ 0x55
        exponent, mantissa = a >> 4 & 7, a & 15
        size = (mantissa << 4) + 8 if exponent == 0 else ((mantissa << 4) + 264) << (exponent - 1)
        assert media.a_law_table()[code] == (size if a & 128 else -size)


def adpcm_by_sample(data, block):
    out = []
    for at in range(0, len(data) - block + 1, block):
        value, index = struct.unpack_from("<hB", data, at)
        index = min(index, 88)
        out.append(value)
        for byte in data[at + 4 : at + block]:
            for code in (byte & 15, byte >> 4):
                step = int(media.STEPS[index])
                change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - change if code & 8 else value + change))
                index = max(0, min(88, index + int(media.CHANGES[code])))
                out.append(value)
    return out


def test_adpcm_against_a_loop_over_samples():
    rng = np.random.default_rng(3)
    noise = rng.integers(0, 256, 256 * 7 + 50, dtype=np.uint8).tobytes()
    assert media.decode_adpcm(noise, 256).tolist() == adpcm_by_sample(noise, 256)
    files = [(6000 * np.sin(np.arange(n) / (5 + n % 7))).astype(np.int16) for n in (0, 1, 505, 506, 4000)]
    assert media.encode_adpcm_files(files) == [media.encode_adpcm(f) for f in files]
    for made, f in zip(media.encode_adpcm_files(files), files, strict=True):
        back = np.array(adpcm_by_sample(made, 256)[: len(f)])
        assert len(f) < 300 or np.abs(back[100:505] - f[100:505].astype(int)).max() < 3000


def test_media_against_plain_code(spark, odd):
    stored = media.media_column(odd)
    both = media.convert_column(media.convert_column(stored, "adpcm", out_col="adpcm"), "pcm", "adpcm", "pcm")
    rows = media.describe_column(both, more=("adpcm", "pcm")).collect()
    assert len(rows) == odd.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], r)
    for k in (0, 1, 2, 5, 7, 9):
        raw = (ODD[k] or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = by_id[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        samples = media.mu_law_table()[np.frombuffer(payload, np.uint8)]
        assert r["feature"] == media.feature(media.resample(samples, 8000, 16000))
        heard = np.array(adpcm_by_sample(media.encode_adpcm(samples), 256)[: len(samples)], np.int16)
        pcm = media.wave(media.PCM, 16000, media.resample(heard, 8000, 16000).astype("<i2").tobytes(), 2, 16)
        assert (r["pcm_bytes"], r["pcm_sha256"], r["adpcm_feature"]) == (len(pcm), hashlib.sha256(pcm).hexdigest(), r["pcm_feature"])
    assert media.describe_column(media.media_column(odd.limit(0))).count() == 0
    for bad in (b"", b"RIFF", media.store_bytes(b"x")[:-1]):
        with pytest.raises((ValueError, struct.error)):
            media.read_wave(bad)


# encoding


def test_decoding_equals_the_library(spark, odd):
    made = Tokenizer.from_file(bpe.default_vocabulary())
    made.no_truncation(), made.no_padding()
    rows = bpe.decode_documents(bpe.encode_documents(odd.where("doc_id IS NOT NULL"))).collect()
    for r in rows:
        ids = made.encode(ODD[r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["decoded"] == made.decode(ids, skip_special_tokens=False)
    assert bpe.decode_documents(bpe.encode_documents(odd.limit(0))).count() == 0


def test_encoder_forgets_and_still_agrees():
    rng = np.random.default_rng(1)
    small, large = bpe.WordBpe(bpe.default_vocabulary(), 40), bpe.tokenizer(bpe.default_vocabulary())
    for _ in range(30):
        text = " ".join("".join(rng.choice(list("abcdeé,."), rng.integers(1, 80 if rng.random() < 0.1 else 6))) for _ in range(40))
        assert small.encode(text) == large.encode(text)
    assert len(small._chunks.keys) <= 40


# dedup and the pipeline


@pytest.mark.parametrize("fan_in", [None, 2, 3, 16])
def test_exact_dedup_over_many_runs(spark, fan_in):
    rows = [(k if k % 50 else None, f"text  {k % 37}" if k % 3 else f"text\t{k % 37}") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(23)
    least, count = {}, {}
    for k, t in rows:
        t = re.sub(r"\s+", " ", t)
        least[t] = min(x for x in (least.get(t), k) if x is not None) if k is not None or least.get(t) is not None else None
        count[t] = count.get(t, 0) + 1
    found = exact_dedup.exact_dedup(df, fan_in=fan_in)
    assert "SortAggregate" in found._jdf.queryExecution().executedPlan().toString()
    got = found.collect()
    assert len(got) == 600 and {(r["keep_id"], r["group_size"]) for r in got} == {(least[t], count[t]) for t in least}
    assert sum(r["kept"] for r in got) == 37


def test_bases_of_runs():
    assert [exact_dedup.base_of(n) for n in (1, 2, 64, 65, 4096, 4097, 10**6)] == [2, 2, 2, 4, 4, 8, 16]


def test_stages_of_odd_tables(spark, odd, labelled, tmp_path):
    _, labels = labelled
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert name == "packing" or out.columns == docs.columns
            out.collect()
    texts = lambda df: sorted((r["text"] is None, r["text"] or "") for r in df.select("text").collect())
    once = corpus_pipeline.exact_dedup_stage(spark, odd, "")
    assert texts(once) == sorted({(False, "") if not t else (False, t) for t in ODD if t} | {(True, "")}) or len(texts(once)) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in ODD})
    assert corpus_pipeline.near_dup_stage(spark, odd, "").where("text = 'a b'").count() == 2  # one row, twice there


def test_near_dup_keeps_rows_by_text(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(words)), (1, " ".join([*words, "more"])), (2, " ".join(["less", *words])), (3, "another text of its own here"), (4, None), (5, "")]
    kept = corpus_pipeline.near_dup_stage(spark, spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, __stays string"), "").collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 3, 4, 5] and len(kept) == 4


def test_pipeline_against_plain_python(spark, tmp_path):
    """run() over files equals its stages by brute force; models are the library's, applied on the driver."""
    rng = np.random.default_rng(12)
    letters = {"de": "abcdß", "en": "efgho"}
    word = lambda y: "".join(rng.choice(list(letters[y]), rng.integers(3, 8)))
    rows, labels = [], []
    for k in range(300):
        y = ("de", "en")[k % 2]
        words = [word(y) for _ in range(50)]
        if k % 10 == 0:
            for place in rng.integers(0, 50, 5):
                words[place] = "feoghhe"
        rows.append([k, " ".join(words), y, "s", 1])
        labels.append((k, 1, int(k % 10 == 0)))
    for k in range(300, 340):
        rows.append([k, rows[k - 299][1].replace(" ", "  ") if k % 2 else rows[k - 299][1] + " " + word("en"), None, "s", 1])
    rows += [[400, None, None, None, None], [401, "", None, None, None], [402, "12 34", None, None, None]]
    docs = spark.createDataFrame(rows, DOCS)
    docs.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    labels_df = spark.read.parquet(str(tmp_path / "labels.parquet"))
    crf = language.train(docs, language.held_out("doc_id"))
    told = language.Scorer(crf).judge([r[1] for r in rows])
    left = [r for r, (lang, _, sure) in zip(rows, told, strict=True) if lang != "und" and sure >= corpus_pipeline.LEAST_CERTAINTY]
    assert len(left) == 340
    lexicon = toxicity.train(spark.createDataFrame(left, DOCS), labels_df, toxicity.held_out("doc_id"))
    machine, (bias, a, b) = lexicon.automaton(), lexicon.curve
    left = [r for r in left if bias + a * (m := toxicity.measures(machine, r[1]))[0] + b * m[1] < 0]
    assert 290 < len(left) < 320 and not {r[0] for r in left} & set(range(0, 300, 10))
    first = {}
    for r in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), r)
    left = list(first.values())
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (r[1].lower().split() for r in left)]
    least = list(range(len(left)))
    for _ in range(3):
        for i in range(len(left)):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    least[i] = least[j] = min(least[i], least[j])
    kept = {left[k][0]: left[k][1] for k in set(least)}
    assert len(kept) < len(left)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    encode = bpe.tokenizer(bpe.default_vocabulary()).encode
    got = {}
    for p in sorted(pieces, key=lambda p: p["start"]):
        got.setdefault(p["doc_id"], []).append(p)
    assert set(got) == set(kept)
    for k, parts in got.items():
        ids = np.array([*encode(kept[k]), 1], "<u4")
        assert [p["start"] for p in parts] == np.cumsum([0, *(p["length"] for p in parts[:-1])]).tolist() and sum(p["length"] for p in parts) == len(ids) == parts[0]["doc_tokens"]
        assert [p["ids_crc32"] for p in parts] == [zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) for p in parts]
    ends = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert ends.get(p["sequence_id"], 0) == p["offset"]
        ends[p["sequence_id"]] = p["offset"] + p["length"]
    assert all(n == packing.WINDOW for s, n in ends.items() if s < max(ends))


def test_queries_of_this_package_are_registered():
    import __spark_entry__
    from lodestack.llm import catalog

    names = set(__spark_entry__.queries())
    assert {f"op{k}_" for k in range(1, 14)} == {re.match(r"op\d+_", n)[0] for n in catalog.queries()} and {*catalog.queries(), "pipeline"} <= names
    assert ngram_join.op10_ngram_join is catalog.queries()["op10_ngram_join"]
