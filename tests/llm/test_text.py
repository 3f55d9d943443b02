"""Fingerprints, language ID, tokens, scores and the mix against plain versions."""
import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from ledgerlark.llm import backoff_lm, bpe, language_id, source_mix, trie_counts, winnowing
from ledgerlark.llm.queries import op2_winnowing_fingerprints, op7_language_id

from ..conftest import SF_SMALL
from .helpers import SCHEMA, awkward_texts, frame, prose, words

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def tiktoken_encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS),
                             special_tokens={})


# ---- BPE ------------------------------------------------------------------

def test_merge_replay_equals_tiktoken(tiktoken_encoding):
    rng = random.Random(5)
    parts = ["a", "b", "the", "ing", "é", "日", "!", "0", "\n", "  ", "ß", "aa", "<|endoftext|>"]
    pieces = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 20))) for _ in range(3000)] + ["a" * 3000, " "]
    replay = bpe.MergeReplay(tiktoken_encoding._mergeable_ranks)
    got = replay.encode([p.encode() for p in pieces])
    assert got == [tiktoken_encoding._core_bpe.encode_single_piece(p.encode()) for p in pieces]
    assert [replay.encode_one(p.encode()) for p in pieces[:100]] == [
        tiktoken_encoding._core_bpe.encode_single_piece(p.encode()) if replay.ranks.get(p.encode()) is None
        else replay.encode_one(p.encode()) for p in pieces[:100]]
    assert all(bpe.decode_ids(replay.token, ids) == p.encode() for ids, p in zip(got, pieces))


def test_merges_that_make_a_lower_rank():
    """An odd vocabulary: 'bc' after 'ab' gives 'abc' a rank below the merge that makes it possible."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 300, b"ab": 310, b"cd": 305, b"aa": 320, b"aaaa": 301}
    replay = bpe.MergeReplay(ranks)
    rng = random.Random(1)
    pieces = [bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 14))) for _ in range(2000)]
    for piece, ids in zip(pieces, replay.encode(pieces)):
        assert ids == ([ranks[piece]] if piece in ranks else replay.encode_one(piece))


def test_encode_documents(spark, tiktoken_encoding):
    texts = awkward_texts()
    got = bpe.encode_documents(frame(spark, texts, [(None, "x y", None, None, None), (5, texts[5], "en", "a", 1)]),
                               RANKS, public_tokenizers.PATTERN, tuple(bpe.OUTPUTS)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter([*texts, None, 5])
    for r in got:
        text = (texts[r["doc_id"]] or "") if r["doc_id"] is not None else "x y"
        ids = tiktoken_encoding.encode_ordinary(text)
        assert list(r["ids"]) == ids and r["n_tokens"] == len(ids) and bytes(r["decoded"]) == text.encode()
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_documents(spark.createDataFrame([], SCHEMA), RANKS, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.encode_documents(frame(spark), RANKS, public_tokenizers.PATTERN, ("tokens",))


def test_missing_bytes_are_told():
    with pytest.raises(ValueError):
        bpe.MergeReplay({b"a": 0})


# ---- trie counts ----------------------------------------------------------

def plain_count(word, trie):
    text, best = trie_counts.MARK + word, [(0.0, 0)]
    for end in range(1, len(text) + 1):
        n = len(text[end - 1].encode())
        found = [(best[end - 1][0] + n * trie.byte_score, best[end - 1][1] + n)]
        found += [(best[i][0] + trie.scores[text[i:end]], best[i][1] + 1) for i in range(end) if text[i:end] in trie.scores]
        best.append(max(found, key=lambda x: (x[0], -x[1])))
    return best[-1][1]


def test_trie_counts(spark):
    scores = trie_counts.load_piece_scores(public_tokenizers.path("piece_bpe_32k.model"))
    trie = trie_counts.TrieCounts(scores)
    texts = {i: t for i, t in awkward_texts().items() if len(t or "") < 4000}
    distinct = sorted({w for t in texts.values() for w in words(t)} | {"ab", "abc", "abd", "日本語"})
    assert trie.count([trie_counts.MARK + w for w in distinct]) == [plain_count(w, trie) for w in distinct]
    got = trie_counts.count_tokens(frame(spark, texts, [(None, "ab ab", None, None, None)]), scores).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in got} == {
        i: (len(words(t)), sum(plain_count(w, trie) for w in words(t))) for i, t in [*texts.items(), (None, "ab ab")]}
    assert trie_counts.count_tokens(spark.createDataFrame([], SCHEMA), scores).count() == 0


# ---- stupid backoff -------------------------------------------------------

def plain_scores(rows, order, factor):
    def grams(w, n):
        return Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1))

    tokens = [words(t) for _, t in rows]
    total = [sum((grams(w, n) for w in tokens), Counter()) for n in range(order + 1)]
    n_words, out = sum(map(len, tokens)), []
    for w in tokens:
        own, rest, score = [grams(w, n) for n in range(order + 1)], n_words - len(w), 0.0
        for j in range(len(w)):
            back, value = 0.0, None
            for n in range(min(order, j + 1), 0, -1):
                gram = tuple(w[j - n + 1:j + 1])
                count = total[n][gram] - own[n][gram]
                if count > 0:
                    history = rest if n == 1 else total[n - 1][gram[:-1]] - own[n - 1][gram[:-1]]
                    value = math.log(count / history)
                    break
                back += math.log(factor) if n > 1 else 0.0
            score += back + (math.log(1 / (rest + 1)) if value is None else value)
        out.append((len(w), score))
    return out


@pytest.mark.parametrize("order", [1, 3])
def test_backoff_scores(spark, order):
    texts = awkward_texts()
    rows = [*texts.items(), (None, texts[9]), (6, texts[6])]
    docs = frame(spark, texts, [(None, texts[9], None, None, None), (6, texts[6], "en", "a", 1)])
    got = backoff_lm.backoff_scores(docs, order, chunk_bytes=2000).collect()
    want = sorted(((-1 if i is None else i), n, s) for (i, _), (n, s) in zip(rows, plain_scores(rows, order, backoff_lm.FACTOR)))
    have = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["n_words"], r["log_score"]) for r in got)
    assert [h[:2] for h in have] == [w[:2] for w in want]
    assert np.allclose([h[2] for h in have], [w[2] for w in want])
    assert all((r["mean_log_score"] is None) == (r["n_words"] == 0) for r in got)
    assert backoff_lm.backoff_scores(spark.createDataFrame([], SCHEMA), order).count() == 0


def test_packed_counts():
    counts = np.array([0, 1, 254, 255, 256, 10**12, 3])
    assert backoff_lm._unpack_counts(backoff_lm._pack_counts(counts), 7).tolist() == counts.tolist()
    keys = np.array([0, 5, 2**39, 2**40 - 1], np.uint64)
    assert backoff_lm._unpack(backoff_lm._pack(keys), 4).tolist() == keys.tolist()
    assert backoff_lm._unpack(backoff_lm._pack(keys[:2]), 2).tolist() == keys[:2].tolist()


# ---- winnowing ------------------------------------------------------------

def test_winnow_is_the_definition():
    rng = random.Random(3)
    for n in (0, 1, 11, 12, 43, 44, 400):
        for letters in ("a", "ab", "abcdefgh "):
            text = "".join(rng.choice(letters) for _ in range(n))
            hashes, places = winnowing.winnow(text)
            if n < winnowing.GRAM:
                assert len(hashes) == (n > 0)
                continue
            codes = np.array([ord(c) for c in text], np.uint64)
            value = [int(h) >> 20 for h in winnowing.window_hashes(codes, winnowing.GRAM)]
            window, kept = min(winnowing.WINDOW, len(value)), []
            for i in range(len(value) - window + 1):
                least = min(value[i:i + window])
                at = max(j for j in range(i, i + window) if value[j] == least)
                if not kept or kept[-1] != at:
                    kept.append(at)
            assert places.tolist() == kept


def test_winnow_blocks_and_match_guarantee(monkeypatch):
    rng = random.Random(4)
    shared = "".join(rng.choice("abcdef") for _ in range(winnowing.GRAM + winnowing.WINDOW - 1))
    for _ in range(50):
        a = "".join(rng.choice("uvw") for _ in range(90)) + shared + "1" * 40
        b = "".join(rng.choice("xyz") for _ in range(33)) + shared
        assert set(winnowing.winnow(a)[0].tolist()) & set(winnowing.winnow(b)[0].tolist())
    text = "".join(rng.choice("abcd ") for _ in range(3000))
    whole = winnowing.winnow(text)
    monkeypatch.setattr(winnowing, "_BLOCK", 64)
    cut = winnowing.winnow(text)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_edited_fingerprints(spark):
    texts = awkward_texts()
    texts[50] = texts[6]
    got = {r["doc_id"]: r for r in winnowing.edited_fingerprints(frame(spark, texts, [(None, "last of all", None, None, None)]))
           .collect()}
    order = [*sorted(texts, reverse=True), None]
    text_of = {**texts, None: "last of all"}
    assert len(got) == len(order)
    for i, following in zip(order, [*order[1:], order[0]]):
        text, after = text_of[i] or "", text_of[following] or ""
        n = len(text)
        edited = text[:n - n // 3] + after[:n // 3]
        own, changed, other = (np.unique(winnowing.winnow(t)[0]) for t in (text, edited, after))
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == winnowing.digest(winnowing.winnow(text))
        assert r["edited_fingerprint"] == winnowing.digest(winnowing.winnow(edited))
        assert r["near_edited"] == winnowing.likeness(own, changed) and r["near_next"] == winnowing.likeness(own, other)
    assert got[50]["fingerprint"] == got[6]["fingerprint"]
    one = winnowing.edited_fingerprints(frame(spark, {1: "only one here"})).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert winnowing.edited_fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    plain = {r["doc_id"]: r for r in winnowing.fingerprint_documents(frame(spark, texts)).collect()}
    assert plain[6]["positions"] == winnowing.winnow(texts[6])[1].tolist() and plain[0]["hashes"] == []


def test_fingerprints_tell_edits_from_strangers(spark):
    rows = op2_winnowing_fingerprints(spark, SF_SMALL).where("n_chars > 300").collect()
    assert np.mean([r["near_edited"] for r in rows]) > 0.4 and np.mean([r["near_next"] for r in rows]) < 0.05


# ---- language ID ----------------------------------------------------------

def test_gram_counts_by_hand(monkeypatch):
    grams, counts = language_id.gram_counts("Ab, a1")
    name = {"".join(chr(int(g) >> s & 0x1FFFFF) for s in (42, 21, 0)).strip("\0").replace("\0", "_"): int(n)
            for g, n in zip(grams, counts)}
    assert sum(counts) == 3 + 5 + 3 and name["a"] >= 2
    text = "the quick brown fox " * 40
    whole = language_id.gram_counts(text)
    monkeypatch.setattr(language_id, "_BLOCK", 50)
    cut = language_id.gram_counts(text)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_languages(spark):
    rng = random.Random(6)
    stems = {"xx": ["the", "ing", "tion", "was"], "yy": ["ich", "sch", "und", "ßer"]}
    texts, langs = {}, {}
    for i in range(120):
        lang = ["xx", "yy"][i % 2]
        texts[i] = " ".join(rng.choice(stems[lang]) + rng.choice(stems[lang]) for _ in range(30))
        langs[i] = lang
    texts |= {200: None, 201: "", 202: "123 !!! 45", 203: "THETION WASING " * 3}
    rows = [(i, t, langs.get(i, "xx" if i == 202 else None), 0.25, "k") for i, t in texts.items()] + [(None, "undich schund", "yy", 0.5, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")
    got = {r["doc_id"]: r for r in language_id.identify_languages(docs).collect()}
    assert all(got[i]["lang_pred"] == langs[i] and 0 < got[i]["score"] <= 1 for i in langs)
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (200, 201, 202))
    assert got[203]["lang_pred"] == "xx" and got[None]["lang_pred"] == "yy"
    assert language_id.identify_languages(docs.limit(0)).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identify_languages(unlabelled).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = op7_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = got.where("lang = lang_pred").count()
    assert got.count() > 100 and right >= 0.98 * got.count()


# ---- mix ------------------------------------------------------------------

def plain_targets(sizes, weights, epochs):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(sizes.values())
    while True:
        share = sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * left / share > epochs * sizes[s]} if open_ else set()
        if not over:
            return target | {s: weight[s] * left / share for s in open_}
        for s in over:
            target[s] = float(epochs * sizes[s])
            left -= target[s]
        open_ -= over


def test_mix(spark):
    rng = random.Random(8)
    rows, quality = [], []
    for i in range(900):
        source = rng.choice(["a"] * 12 + ["b", "b", "é", None, "tiny", "z", "zz"])
        rows.append((i, prose(rng, rng.randrange(0, 60)) if i % 50 else None, source, i, "k"))
        if i % 3 == 0:
            quality.append((i, [0.5, 1.5, None, -1.0][i % 4]))
    rows += [(None, "x y z", "b", 1, "k"), (None, "x y z", "b", 1, "k"), (3, "other text", "zz", 1, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, copies string")
    weight = spark.createDataFrame(quality + quality[:5], "doc_id long, weight double")
    got = source_mix.mix_sources(docs, weight)
    one = sorted(map(repr, got.collect()))
    assert one == sorted(map(repr, source_mix.mix_sources(docs.repartition(5), weight).collect()))
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += len(words(r[1]))
    target = plain_targets(sizes, (1, 2, 3), 3)
    taken = Counter()
    assert got.count() == len(rows)
    for r in got.collect():
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], target[r["source"]], rel_tol=1e-12)
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 60 for s in sizes)  # within the largest document
    assert math.isclose(sum(target.values()), sum(sizes.values()))
    mixed = source_mix.mixed_documents(docs, weight)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter(
        r["doc_id"] for r in got.collect() for _ in range(r["copies"]))


def test_mix_prefers_quality_and_handles_nothing(spark):
    docs = spark.createDataFrame([(i, "a b c d", "s" if i < 2000 else "t") for i in range(2200)],
                                 "doc_id long, text string, source string")
    weight = spark.createDataFrame([(i, 3.0 if i % 2 else 0.5) for i in range(2000)], "doc_id long, weight double")
    got = source_mix.mix_sources(docs, weight, weights=(1, 1), max_epochs=3).where("source = 's'").collect()
    good = sum(r["copies"] for r in got if r["doc_id"] % 2)
    assert good > 1.2 * sum(r["copies"] for r in got if not r["doc_id"] % 2)
    assert source_mix.mix_sources(docs.limit(0)).count() == 0


def test_mix_buckets_stay_even_under_extreme_weights(spark):
    docs = spark.createDataFrame([(i, "a b c d", "s" if i < 4000 else "t") for i in range(4400)],
                                 "doc_id long, text string, source string")
    weight = spark.createDataFrame([(7, 1e-6), (8, 1e6)], "doc_id long, weight double")
    plain = source_mix.mix_sources(docs, weight, weights=(1, 1)).collect()
    assert {r["doc_id"]: r["copies"] for r in plain}[8] >= 1
    taken = sum(r["taken"] for r in plain if r["source"] == "s")
    assert abs(taken - [r["target"] for r in plain if r["source"] == "s"][0]) <= 4
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")  # other buckets, same rows
    try:
        assert sorted(map(repr, source_mix.mix_sources(docs, weight, weights=(1, 1)).collect())) == sorted(map(repr, plain))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    blank = source_mix.mix_sources(spark.createDataFrame([(1, None, None), (2, " ", "s")],
                                                         "doc_id long, text string, source string")).collect()
    assert all((r["size"], r["taken"], r["target"]) == (0, 0, 0.0) for r in blank)
