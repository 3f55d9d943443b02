"""MinHash, substring, line and embedding dedup against plain versions."""
import hashlib
import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from ledgerlark.llm import embedding_dedup, minhash_dedup, substring_dedup
from ledgerlark.llm.components import connected_components
from ledgerlark.llm.line_templates import drop_recurring_lines, line_dedup
from ledgerlark.llm.words import window_hashes, word_slices

from .helpers import SCHEMA, awkward_texts, components, frame, lower, prose, words


def shingles(text, width):
    w = words(lower(text))
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}


def test_word_hashes_follow_the_words():
    import pyarrow as pa

    texts = [t for t in awkward_texts().values()]
    seen = {}
    for first, stop, hashes, at in word_slices(pa.array(texts, pa.string())):
        for i in range(first, stop):
            own = hashes[at[i - first]:at[i - first + 1]].tolist()
            assert len(own) == len(words(texts[i]))
            for w, h in zip(words(texts[i]), own):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_word_hashes_of_a_text_over_many_blocks(monkeypatch):
    import pyarrow as pa

    from ledgerlark.llm import words as module

    column = pa.array(["ab  cd " * 50 + "x" * 300, None, "q", "r s"], pa.string())
    whole = [(a, b, h.tolist(), o.tolist()) for a, b, h, o in word_slices(column)]
    monkeypatch.setattr(module, "SLICE_BYTES", 64)
    cut = [x for _, _, h, _ in word_slices(column) for x in h.tolist()]
    assert cut == whole[0][2] and len(whole) == 1


def test_windows_are_position_free():
    h = np.arange(1, 50, dtype=np.uint64)
    a = window_hashes(np.concatenate([h, h]), 7)
    assert (a[:43] == a[49:92]).all() and len(set(a.tolist())) == 49


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    links += [(2000, 2000 + i) for i in range(1, 50)] + [(7, 7), (5, 6), (6, 5)]
    want = components({x for p in links for x in p}, links)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {i: c for i, c in want.items() if i in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_minhash_components(spark):
    texts = awkward_texts()
    rng = random.Random(11)
    base = prose(rng, 150, 10**6).split(" ")
    for i in range(40):  # a family: each copy has its own edits, pairs lie on both sides of the threshold
        own = list(base)
        for _ in range(i % 8):
            own[rng.randrange(len(own))] = f"edit{rng.randrange(10**9)}"
        texts[100 + i] = " ".join(own)
    sets = {i: shingles(t, 4) for i, t in texts.items()}
    links = [(a, b) for a, b in combinations(texts, 2) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(texts, links)
    extra = [(None, texts[6], "en", "a", 1), (6, texts[6], "en", "a", 1)]
    got = minhash_dedup.minhash_components(frame(spark, texts, extra), 4, 80).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["n_shingles"]) == (want[r["doc_id"]], len(sets[r["doc_id"]]))
            assert r["kept"] == (r["component_id"] == r["doc_id"])


def test_minhash_empty_table_and_stage(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert minhash_dedup.minhash_components(empty).count() == 0
    docs = frame(spark, {1: "a b c d e f", 2: "A b c d e f", 3: None, 4: ""})
    assert sorted(r["doc_id"] for r in minhash_dedup.near_dedup(docs).collect()) == [1, 3, 4]
    with pytest.raises(ValueError):
        minhash_dedup.minhash_components(docs, percent=50)


def test_pigeonhole_guarantee():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 16, (200, minhash_dedup.SYMBOLS)).astype(np.uint16)
    other = base.copy()
    for row in other:  # exactly the largest distance
        at = rng.choice(minhash_dedup.SYMBOLS, minhash_dedup.MAX_DISTANCE, replace=False)
        row[at] ^= 1
    a, b = minhash_dedup.signature_keys(base), minhash_dedup.signature_keys(other)
    assert (a == b).any(axis=1).all()


def test_histogram_bound_never_drops_a_link():
    rng = np.random.default_rng(8)
    for n in (1, 3, 60, 64, 100, 300, 511, 513, 5000, 20000):
        for gone in (0, n // 20, n // 10, n // 9, n // 5, n // 2):
            x = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
            y = np.unique(np.concatenate([x[gone:], rng.integers(0, 1 << 63, gone // 2, np.uint64)]))
            if not len(y):
                continue
            both = len(np.intersect1d(x, y))
            a, b = minhash_dedup.histogram(x), minhash_dedup.histogram(y)
            bound = minhash_dedup.most_shared(a, np.stack([b, b]))
            assert (bound >= both).all() and (bound == minhash_dedup.most_shared(b, a[None])[0]).all()
            assert int(a.sum()) == len(x)


def test_family_below_the_threshold_beside_links(spark):
    """More members than a block, all pairs below the threshold but for some; long and short sets mix."""
    rng = random.Random(4)
    base = prose(rng, 120, 10**6).split(" ")
    texts = {}
    for i in range(600):
        own = list(base)
        for at in rng.sample(range(0, 120, 5), 5):
            own[at] = f"edit{rng.randrange(10**9)}"
        texts[i] = " ".join(own + ["tail"] * (i % 3))
    texts[700] = texts[5] + " one more"
    texts[701] = texts[599].upper()
    sets = {i: shingles(t, 5) for i, t in texts.items()}
    links = [(a, b) for a, b in combinations(texts, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert 2 <= len(links)
    want = components(texts, links)
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.minhash_components(frame(spark, texts), 5, 80).collect()}
    assert got == want


def plain_substring(texts, width):
    places = Counter(tuple(w[i:i + width]) for w in map(words, texts) for i in range(len(w) - width + 1))
    out = []
    for w in map(words, texts):
        gone = set()
        for i in range(len(w) - width + 1):
            if places[tuple(w[i:i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("width", [35, 5])
def test_substring_dedup(spark, width):
    texts = awkward_texts()
    rows = list(texts.items()) + [(9, texts[9]), (None, texts[10]), (None, None)]
    want = Counter((i, *r) for (i, _), r in zip(rows, plain_substring([t for _, t in rows], width)))
    docs = frame(spark, texts, [(9, texts[9], "en", "a", 1), (None, texts[10], None, None, None), (None, None, None, None, None)])
    got = substring_dedup.remove_repeats(docs, width)
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got.collect()) == want
    digests = substring_dedup.remove_repeats(docs, width, want_text=False).select("kept").collect()
    assert Counter(r["kept"] for r in digests) == Counter(
        h for (_, _, _, kept), n in want.items() for h in [hashlib.sha256(kept.encode()).hexdigest()] * n)
    for r in got.collect():  # the intervals are maximal and cover what was removed
        spans = [(s["begin"], s["end"]) for s in r["removed"]]
        assert sum(e - b for b, e in spans) == r["n_removed"]
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_substring_empty_table(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def lettered(*args):
    """Prose without digits, which lines keep as constant words of their templates."""
    return prose(*args).translate(str.maketrans("0123456789", "abcdefghij"))


def test_line_templates(spark):
    rng = random.Random(2)
    texts = {}
    for i in range(30):
        own = [lettered(rng, 12, 10**6) for _ in range(4)]
        own.insert(rng.randrange(4), f"Page {i} of {rng.randrange(9)}")  # a variable field
        own.insert(2, "All rights reserved here.")
        texts[i] = "\n".join(own)
    copied = "\n".join(lettered(rng, 12, 10**6) for _ in range(5))
    for i in range(100, 120):  # copies move together: their lines are no boilerplate
        texts[i] = copied + f"\nend {chr(97 + i - 100)} {lettered(rng, 6, 10**6)}"
    texts |= {200: None, 201: "", 202: "\n\n", 203: "All rights reserved here."}
    docs = frame(spark, texts, [(None, texts[0], "en", "a", 1)])
    got = {r["doc_id"]: r for r in drop_recurring_lines(docs).collect()}
    assert len(got) == len(texts) + 1
    for i in range(30):
        kept = [x for x in texts[i].split("\n") if not x.startswith("Page") and x != "All rights reserved here."]
        assert got[i]["text"] == "\n".join(kept) and got[i]["n_dropped"] == 2 and got[i]["n_lines"] == 6
    for i in range(100, 120):
        assert got[i]["text"] == texts[i]
    assert got[None]["text"] == got[0]["text"]
    assert (got[200]["text"], got[200]["n_lines"]) == (None, 0) and got[201]["text"] == "" and got[202]["text"] == "\n\n"
    assert got[203]["text"] == "" and got[203]["n_dropped"] == 1
    stage = line_dedup(docs)
    assert stage.columns == docs.columns and {r["doc_id"]: r["text"] for r in stage.collect()} == {
        i: r["text"] for i, r in got.items()}
    assert drop_recurring_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_boilerplate_with_constant_neighbours(spark):
    rng = random.Random(12)
    block = ["Example Press Limited", "12 Harbour Street", "All prices include tax.", "Write to us at any time."]
    texts, want = {}, {}
    for i in range(20):  # a notice between blank lines, a fixed block of four lines
        own = [lettered(rng, 14, 10**6) for _ in range(4)]
        texts[i] = "\n".join([own[0], "", "This notice is on every page.", "", own[1], *block, own[2], own[3]])
        want[i] = "\n".join([own[0], "", "", own[1], own[2], own[3]])
    copied = [lettered(rng, 14, 10**6) for _ in range(8)]
    for i in range(100, 300):  # a big family of edited copies has a line that unrelated documents have, too
        own = copied[:3] + ["Seen here and there alike."] + copied[3:]
        own[rng.choice([0, 1, 2, 4, 5, 6, 7, 8])] = lettered(rng, 14, 10**6)
        texts[i], want[i] = "\n".join(own), "\n".join(x for x in own if not x.startswith("Seen"))
    for i in range(300, 312):
        own = [lettered(rng, 14, 10**6) for _ in range(3)]
        texts[i], want[i] = "\n".join([own[0], "Seen here and there alike.", *own[1:]]), "\n".join(own)
    for i in range(400, 412):  # three documents, four edited copies each: a line in three families does not recur
        if i % 4 == 0:
            base = [lettered(rng, 14, 10**6) for _ in range(6)]
        texts[i] = want[i] = "\n".join([*base[:3], "Only three families say this.", *base[3:], lettered(rng, 5, 10**6)])
    got = {r["doc_id"]: r["text"] for r in line_dedup(frame(spark, texts)).collect()}
    assert {i for i in texts if got[i] != want[i]} == set()


def test_pages_that_are_mostly_boilerplate(spark):
    rng = random.Random(21)
    menu = ["Home | Products | About us", "Call us at any time of day", "All rights reserved by Example Press", "Terms and privacy"]
    texts, want = {}, {}
    for i in range(60):  # a four-line menu and footer around one own sentence
        own = lettered(rng, 14, 10**6)
        texts[i], want[i] = "\n".join([*menu[:2], own, *menu[2:]]), own
    for k in range(3):  # families of copies with scattered word edits: lines often differ, their ends seldom
        base = [lettered(rng, 40, 10**6).split() for _ in range(9)]
        for i in range(40):
            lines = [list(x) for x in base]
            for line in rng.sample(lines, 5):
                line[rng.randrange(len(line))] = lettered(rng, 1, 10**6)
            texts[1000 * (k + 1) + i] = want[1000 * (k + 1) + i] = "\n".join(map(" ".join, lines))
    got = {r["doc_id"]: r["text"] for r in line_dedup(frame(spark, texts)).collect()}
    assert {i for i in texts if got[i] != want[i]} == set()


def test_embedding_components(spark):
    rng = np.random.default_rng(1)
    rows, vectors = [], {}

    def add(x, label):
        i = len(rows)
        rows.append((i, None if x is None else [None if v is None else float(v) for v in x], label, 5, "n"))
        vectors[i] = (x, label)

    for label in (0, 1):
        for _ in range(150):
            add(rng.normal(size=16), label)
    centre = rng.normal(size=16)
    for _ in range(120):  # a dense group larger than any adjacency list
        add(centre + rng.normal(size=16) * 0.05, 0)
    for _ in range(30):
        add(centre * 2, 1)
    for bad in (None, [], [0.0] * 16, [math.nan] * 16, [math.inf] + [1.0] * 15, [None] + [1.0] * 15):
        add(bad, 0)
    add(centre, None)
    add(list(centre) + [0.0], 0)
    schema = "vec_id long, embedding array<double>, label int, n_links long, space string"
    good = {i: (np.array(x) / np.linalg.norm(x), lab) for i, (x, lab) in vectors.items()
            if lab is not None and x is not None and len(x) and None not in list(x) and np.isfinite(x).all() and np.any(x)}
    links = [(a, b) for a, b in combinations(good, 2) if good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0])
             and good[a][0] @ good[b][0] >= 0.98]
    degree = Counter(x for p in links for x in p)
    want = components(vectors, links)
    got = embedding_dedup.embedding_components(spark.createDataFrame(rows, schema)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {
        i: (degree[i], want[i], want[i] == i) for i in vectors}
    assert embedding_dedup.embedding_components(spark.createDataFrame([], schema)).count() == 0


def test_embedding_recall_over_shards(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD", 100)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(500, 12))
    rows = [(i, [float(v) for v in base[i % 400] + rng.normal(size=12) * 0.02], 1) for i in range(1200)]
    hit, there = embedding_dedup.audit_recall(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert there > 100 and hit >= 0.9 * there


def test_embedding_links_of_a_dense_group_over_the_limit(spark, monkeypatch):
    for name, value in (("SHARD", 50), ("SHARD_LIMIT", 100), ("BLOCK_ROWS", 60)):
        monkeypatch.setattr(embedding_dedup, name, value, raising=False)
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=16) + rng.normal(size=(300, 16)) * 0.05, rng.normal(size=(300, 16))])
    x = np.concatenate([x, x[300:400] + rng.normal(size=(100, 16)) * 0.12])  # a group, background, single pairs
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    degree = (unit @ unit.T >= 0.98).sum(1) - 1
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    got = embedding_dedup.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert degree[:300].sum() > 50_000 and degree[300:400].sum() > 20
    assert {r["vec_id"]: r["n_links"] for r in got.collect()} == dict(enumerate(degree.tolist()))


def test_linked_vectors_share_a_place():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centroids = embedding_dedup.fit_centroids(x, 40)
    places = embedding_dedup._places(x, centroids, 0.98)
    a, b = np.nonzero(x @ x.T >= 0.98)
    home = (x @ centroids.T).argmax(1)
    assert len(a) > 4500 and places[b, home[a]].all() and places.mean() < 0.5


def test_prune_keeps_the_nearest():
    x = np.random.default_rng(0).normal(size=(300, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = embedding_dedup.build_graph(x, 1)
    sim = x @ x.T
    np.fill_diagonal(sim, -2)
    assert (graph[:, 0] == sim.argmax(1)).all()
    assert all(i not in row for i, row in enumerate(graph.tolist()))
