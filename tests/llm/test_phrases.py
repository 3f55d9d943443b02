"""Phrase mining against a plain count of every phrase."""
import random
import re
from collections import Counter

import pytest

from ledgerlark.llm import phrase_mining as pm
from ledgerlark.llm.queries import op13_phrase_collocations

from ..conftest import SF_SMALL
from .helpers import awkward_texts, frame, lower

FIELDS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain_mine(rows, max_words, min_count, inside_percent, top):
    """rows: (lang, text)."""
    n, counts = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                counts.update((lang, *words[i:i + k]) for i in range(len(words) - k + 1))
    found = {p: c for p, c in counts.items() if len(p) > 2 and c >= min_count}
    best = {}
    for (lang, *words), a in found.items():
        inside = any(100 * c >= inside_percent * a for (other, *more), c in found.items()
                     if other == lang and len(more) > len(words)
                     and any(more[i:i + len(words)] == words for i in range(len(more) - len(words) + 1)))
        if not inside:
            cuts = [(counts[lang, *words[:k]], counts[lang, *words[k:]]) for k in range(1, len(words))]
            score, k = min((10 ** 6 * a * a // (x * y), k) for k, (x, y) in enumerate(cuts))
            best.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), *cuts[k]))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s)
                  for lang, all_of in best.items() for i, (s, a, p, x, y) in enumerate(sorted(all_of)[:top]))


def corpus(n, seed=4):
    rng = random.Random(seed)
    words = ["the", "New", "York", "of", "state", "é", "日本", "a\x1fb", "x_y", "#", " ", " ", "\x00", "new", "city"]
    marks = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", " ! ", "\x0b", "?"]
    return [(rng.choice(["en", "en", "en", None, "und", "fr"]),
             "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randrange(0, 60)))) for _ in range(n)]


def mined(spark, rows, **options):
    df = frame(spark, {}, [(i, text, lang, "s", 1) for i, (lang, text) in enumerate(rows)])
    return sorted(tuple(r[f] for f in FIELDS) for r in pm.mine_phrases(df, **options).collect())


@pytest.mark.parametrize("max_words, top", [(2, 2000), (3, 2000), (3, 7), (5, 2000)])
def test_mining(spark, max_words, top):
    rows = corpus(150) + [(["en", None][i % 2], t) for i, t in awkward_texts().items()] + [("en", None), (None, "")]
    options = dict(max_words=max_words, min_count=4, inside_percent=50, top=top)
    want = plain_mine(rows, **options)
    assert mined(spark, rows, **options) == want and len(want) > 10


def test_small_blocks_and_slices(spark, monkeypatch):
    """Blocks end between pieces, also inside one long text; phrases are counted over all blocks."""
    text = " ".join(t or "" for _, t in corpus(400, 9))
    rows = [("en", text), ("en", text[:5000]), ("fr", "word " * 5000), ("fr", "é" * 30_000), (None, text)]
    options = dict(max_words=3, min_count=10, inside_percent=50, top=2000)
    want = plain_mine(rows, **options)
    parts = pm._cut
    whole = [p for _, t in rows for p in parts(t.encode().translate(pm._FOLD))]
    assert len(whole) == len(rows)
    monkeypatch.setattr(pm, "SLICE_BYTES", 700)
    folded = text.encode().translate(pm._FOLD)
    assert b"".join(pm._cut(folded)) == folded and len(list(pm._cut(folded))) > 5
    words = pm._Words()
    for part in pm._cut(folded):
        words.add("en", part)
    codes, groups = pm._unpack(pm.pa.scalar(words.relation(), pm.pa.binary()))
    plain = [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower(text))]
    names = groups["phrase"].to_pylist()
    assert [names[c] for c in codes if c >= 0] == [w for p in plain for w in p]
    pairs, counts = pm.np.unique(pm._adjacent(codes, len(groups))[1], return_counts=True)
    assert dict(zip(((names[p // len(names)], names[p % len(names)]) for p in pairs), counts)) == Counter(
        (a, b) for p in plain for a, b in zip(p, p[1:]))
    df = frame(spark, {}, [(i, t, lang, "s", 1) for i, (lang, t) in enumerate(rows)]).repartition(5)
    assert sorted(tuple(r[f] for f in FIELDS) for r in pm.mine_phrases(df, **options).collect()) == want


def test_large_counts_stay_exact():
    """Scores of counts whose products pass 64 bits."""
    big = 3 * 10 ** 12
    groups = pm.pa.table({"id": [1], "left": [2], "right": [3], "lang": ["en"], "phrase": ["a b"], "total": [big], "owner": [True],
                          "head1": [big + 1], "tail1": [big + 10 ** 7]})
    batch = pm.pa.record_batch({"block": pm.pa.array([0]), "relation": pm.pa.array(
        [pm._pack(pm.np.zeros(0, pm.np.int32), groups)], pm.pa.binary())})
    (row,) = next(pm._scored(iter([batch]))).to_pylist()
    assert row["score"] == 10 ** 6 * big * big // ((big + 1) * (big + 10 ** 7)) and (row["l"], row["r"]) == (big + 1, big + 10 ** 7)


def test_empty_and_wordless(spark):
    options = dict(max_words=3, min_count=2, inside_percent=50, top=10)
    assert mined(spark, [], **options) == []
    assert mined(spark, [("en", None), ("en", " .,\n"), (None, "")], **options) == []


def test_query(spark):
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = sorted(tuple(r[f] for f in FIELDS) for r in op13_phrase_collocations(spark, SF_SMALL).collect())
    assert got == plain_mine(rows, 3, 10, 50, 2000) and got


def test_counts_travel_packed():
    """A block sends a bucket one row with all its counts; the bucket's answer is one row for each block."""
    rng = pm.np.random.default_rng(3)
    codes, size, buckets = rng.integers(0, 3000, 60_000).astype(pm.np.int32), 3000, 4
    groups = pm.pa.table({"id": pm.np.arange(size) + 10 ** 6})
    blocks = pm.pa.record_batch({"block": pm.pa.array([5, 6]), "relation": pm.pa.array([pm._pack(codes, groups)] * 2, pm.pa.binary())})
    sent = pm.pa.Table.from_batches(list(pm._pair_counts(buckets)(iter([blocks]))))
    want = Counter(zip((codes[:-1] + 10 ** 6).tolist(), (codes[1:] + 10 ** 6).tolist()))
    assert len(sent) == 2 * buckets
    assert sum(map(len, sent["counts"].to_pylist())) < 10 * 2 * len(want)
    got, keys = Counter(), pm._pair_keys(*pm._unpack(blocks["relation"][0]))
    members = pm._members(keys[1], buckets)
    for bucket in range(buckets):
        mine = sent.filter(pm.pc.equal(sent["bucket"], bucket))
        _, left, right, n = pm._read_pairs(mine["counts"].to_pylist()[:1])
        got.update(dict(zip(zip(left.tolist(), right.tolist()), n.tolist())))
        told = pm._group_count(pm._read_pairs, 4, buckets, False)(mine).to_pylist()
        assert [r["block"] for r in told] == [5, 6]
        (at, ids, totals, first), (*_, second) = (pm._unsqueeze(r["groups"], 4) for r in told)
        assert first.all() and not second.any() and (ids % buckets == bucket).all() and len(set(ids)) == len(ids)
        for key, total in zip(keys[0][members[bucket][pm.np.cumsum(at)]].tolist(), totals.tolist()):
            assert total == 2 * want[key // size + 10 ** 6, key % size + 10 ** 6] >= 4
        assert len(at) == sum(2 * c >= 4 for c in n.tolist())
    assert got == want
