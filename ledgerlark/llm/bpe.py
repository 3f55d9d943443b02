"""Byte-level BPE by corpus-level merge replay.

The distinct pre-tokens of a whole slice of the corpus are laid out as one array of byte symbols.  An
inverted index maps a merge rank to the word positions where its pair stands.  Ranks are taken in
order; all positions of a rank merge at once, and only the neighbours they touch are looked up and
indexed again.  Words are independent, so replaying each partition's vocabulary gives the same ids as
replaying the corpus at once; no vocabulary is gathered anywhere.

Ids equal those of byte-pair encoding by lowest rank, leftmost first.  A merge may, in theory, create a
pair of a lower rank than the one being replayed; words where this happens are encoded one by one.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 12 << 20
MAX_KNOWN = 200_000
OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded": "binary",
           "decoded_sha256": "string"}
_ARROW = {"long": pa.int64(), "array<int>": pa.list_(pa.int32()), "string": pa.string(), "binary": pa.binary()}


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a rank file (one base64 token and its rank a line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


class MergeReplay:
    """Encodes sets of distinct words by replaying the merges over all of them."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the ranks lack the single bytes {missing[:5]}")
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.token = [b""] * self.size
        for token, rank in ranks.items():
            self.token[rank] = token
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pair_rank: dict[int, int] = {}

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 where their bytes are no token."""
        codes = left * self.size + right
        if len(codes) <= 64:
            return np.array([self._rank(c) for c in codes.tolist()], np.int64)
        codes, back = np.unique(codes, return_inverse=True)
        return np.array([self._rank(c) for c in codes.tolist()], np.int64)[back]

    def _rank(self, code: int) -> int:
        rank = self.pair_rank.get(code)
        if rank is None:  # each pair of symbols is joined once
            left, right = divmod(code, self.size)
            rank = self.pair_rank[code] = self.ranks.get(self.token[left] + self.token[right], -1)
        return rank

    def encode_one(self, word: bytes) -> list[int]:
        """Reference form for one word: the lowest rank merges first, the leftmost on ties."""
        parts = [word[i:i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, self.size), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == self.size:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of every word."""
        whole = [self.ranks.get(w, -1) for w in words]
        open_ = [i for i, r in enumerate(whole) if r < 0 and words[i]]
        done = [[r] if r >= 0 else [] for r in whole]
        if not open_:
            return done
        text = np.frombuffer(b"".join(words[i] for i in open_), np.uint8)
        ends = np.cumsum([len(words[i]) for i in open_])
        symbol, alone = self._replay(self.byte_id[text], ends)
        live = np.flatnonzero(symbol >= 0)
        ids, cut = symbol[live].tolist(), np.searchsorted(live, ends).tolist()
        lo = 0
        for k, hi in zip(open_, cut):
            done[k] = ids[lo:hi]
            lo = hi
        for w in alone:
            done[open_[w]] = self.encode_one(words[open_[w]])
        return done

    def _replay(self, symbol: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Symbols after all merges (-1: merged into its left neighbour), and words to encode singly."""
        n = len(symbol)
        symbol = symbol.copy()
        after = np.arange(1, n + 1, dtype=np.int64)   # next live position of the word, n at its end
        after[ends - 1] = n
        before = np.arange(-1, n - 1, dtype=np.int64)  # -1 at its start
        before[0] = -1
        before[ends[:-1]] = -1
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []
        late: set[int] = set()

        def add(at: np.ndarray, now: int) -> None:
            at = at[after[at] < n]
            if not len(at):
                return
            rank = self._lookup(symbol[at], symbol[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if len(at) and int(rank.min()) <= now:
                early = rank <= now
                late.update(np.searchsorted(ends, at[early], "right").tolist())
                at, rank = at[~early], rank[~early]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, places in zip(rank[np.concatenate([[0], cuts])].tolist() if len(rank) else [], np.split(at, cuts)):
                if r in index:
                    index[r].append(places)
                else:
                    index[r] = [places]
                    heapq.heappush(queue, r)

        add(np.arange(n), -1)
        while queue:
            now = heapq.heappop(queue)
            found = index.pop(now)
            at = found[0] if len(found) == 1 else np.concatenate(found)
            at = np.sort(at)
            if len(found) > 1:
                at = at[np.concatenate([[True], at[1:] != at[:-1]])]
            # an entry is stale if its symbol is gone or has other neighbours by now
            at = at[(symbol[at] >= 0) & (after[at] < n)]
            if not len(at):
                continue
            at = at[self._lookup(symbol[at], symbol[after[at]]) == now]
            if not len(at):
                continue
            # of overlapping pairs every other one merges, from the left
            chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
            if chained.any():
                lead = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - lead) % 2 == 0]
            gone = after[at]
            symbol[at], symbol[gone] = now, -1
            follow = after[gone]
            after[at] = follow
            inner = follow < n
            before[follow[inner]] = at[inner]
            left = before[at]
            add(np.unique(np.concatenate([at, left[left >= 0]])), now)
        return symbol, sorted(late)


class _Words(dict):
    """Numbers of the distinct pre-tokens seen so far, and what encoding made of each."""

    def __init__(self, replay: MergeReplay):
        super().__init__()
        self.replay = replay
        self.new: list[str] = []
        self.ids: list[list[int]] = []
        self.decimal: list[str] = []
        self.decoded: list[bytes] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = number = len(self)
        return number

    def learn(self) -> None:
        """Encode the words that are new since the last call."""
        for ids in self.replay.encode([w.encode("utf-8", "surrogateescape") for w in self.new]):
            self.ids.append(ids)
            self.decimal.append(",".join(map(str, ids)))
            self.decoded.append(decode_ids(self.replay.token, ids))
        self.new = []


def decode_ids(token: list[bytes], ids: Iterable[int]) -> bytes:
    """The bytes that token ids stand for."""
    return b"".join([token[i] for i in ids])


def _columns(rows: list[np.ndarray], words: _Words, outputs: list[str]) -> list[pa.Array]:
    made: dict[str, list] = {o: [] for o in outputs}
    sizes = np.array([len(x) for x in words.ids] or [0], np.int64)
    for numbers in rows:
        row = numbers.tolist()
        if "n_tokens" in made:
            made["n_tokens"].append(int(sizes[numbers].sum()) if row else 0)
        if "ids" in made:
            made["ids"].append(np.fromiter(chain.from_iterable([words.ids[w] for w in row]), np.int32))
        if "ids_sha256" in made:
            text = ",".join([words.decimal[w] for w in row])
            made["ids_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
        if "decoded" in made or "decoded_sha256" in made:
            raw = b"".join([words.decoded[w] for w in row])
            if "decoded" in made:
                made["decoded"].append(raw)
            if "decoded_sha256" in made:
                made["decoded_sha256"].append(hashlib.sha256(raw).hexdigest())
    return [pa.array(made[o], _ARROW[OUTPUTS[o]]) for o in outputs]


def _encode_rows(ranks, pattern: str, outputs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, split = MergeReplay(ranks.value), regex.compile(pattern).findall
        words, ids, rows, size = _Words(replay), [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                ids.append(doc_id)
                pieces = split(raw.decode("utf-8", "surrogateescape"))
                rows.append(np.fromiter(map(words.__getitem__, pieces), np.int32, len(pieces)))
                size += len(raw)
                if size >= SLICE_BYTES:
                    yield _flush(ids, rows, words, outputs)
                    words = words if len(words) < MAX_KNOWN else _Words(replay)
                    ids, rows, size = [], [], 0
        if ids:
            yield _flush(ids, rows, words, outputs)
    return run


def _flush(ids: list, rows: list[np.ndarray], words: _Words, outputs: list[str]) -> pa.RecordBatch:
    words.learn()
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *_columns(rows, words, outputs)],
                                      ["doc_id", *outputs])


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str,
                     outputs: tuple[str, ...] = ("n_tokens", "ids")) -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and the ``outputs`` asked for (keys of ``OUTPUTS``).

    ``ids`` are the token ids of the whole text, each match of ``pattern`` encoded by itself, without special
    tokens; ``decoded`` is what the ids decode to; the digests are SHA-256 of the decimal ids joined by
    commas and of the decoded bytes.  A null or empty text has no tokens.  Only ``doc_id`` and ``text`` are
    read; repeated rows give repeated rows, an empty table an empty result.  The rank file is read on
    the driver and broadcast: its size is that of one vocabulary, not of the data.
    """
    unknown = [o for o in outputs if o not in OUTPUTS]
    if unknown:
        raise ValueError(f"unknown outputs {unknown}; known are {list(OUTPUTS)}")
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    schema = ", ".join(["doc_id long", *(f"{o} {OUTPUTS[o]}" for o in outputs)])
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(_encode_rows(ranks, pattern, list(outputs)), schema))
