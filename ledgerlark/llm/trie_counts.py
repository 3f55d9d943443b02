"""Token counts of a unigram vocabulary by trie-shared dynamic programming.

A text's pre-tokens are its words (``[^\\x20\\x09-\\x0D]+``), each with the word mark ``\\u2581`` in front.  The
distinct pre-tokens of a slice of the corpus, in order, are the leaves of a trie walked depth first: the
forward score of a prefix (the best sum of piece scores that spells it, and the fewest pieces that do)
stays on a stack and serves every pre-token below it.  A pre-token's count is stored at its end, and
a document's count is the sum over its words.

Characters that no piece spells fall back to one token a UTF-8 byte.  Piece scores come from the order of
a public vocabulary: ``-ln(rank + 1)``, the log frequency of Zipf's law.  Nothing is trained.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES, MAX_KNOWN = 12 << 20, 300_000
MARK = "▁"


def load_piece_scores(path: str) -> dict[str, float]:
    """Piece -> score of a sentencepiece model's ordinary pieces, in the order of the model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())
             if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return {piece: -math.log(rank + 1) for rank, piece in enumerate(names, 1)}


class TrieCounts:
    """Counts tokens of pre-tokens; the fallback score of a byte lies below every piece's."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=0)
        self.byte_score = min(scores.values(), default=0.0) - 10.0

    def _extend(self, word: str, end: int, score: list[float], count: list[int]) -> None:
        """Forward score and count of the prefix of length ``end`` from those of its prefixes."""
        n_bytes = len(word[end - 1].encode("utf-8", "surrogatepass"))
        best, fewest = score[end - 1] + n_bytes * self.byte_score, count[end - 1] + n_bytes
        get = self.scores.get
        for start in range(max(0, end - self.longest), end):
            piece = get(word[start:end])
            if piece is not None:
                total, n = score[start] + piece, count[start] + 1
                if total > best or total == best and n < fewest:
                    best, fewest = total, n
        score.append(best)
        count.append(fewest)

    def count(self, words: list[str]) -> list[int]:
        """Token count of every word (without word marks of its own), each trie prefix scored once."""
        out = [0] * len(words)
        score, count, last = [0.0], [0], ""
        for i in sorted(range(len(words)), key=words.__getitem__):
            word = words[i]
            shared = len(commonprefix((last, word)))
            del score[shared + 1:], count[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                self._extend(word, end, score, count)
            out[i], last = count[-1], word
        return out


class _Numbers(dict):
    """Numbers of distinct pre-tokens and their token counts."""

    def __init__(self, trie: TrieCounts):
        super().__init__()
        self.trie, self.new, self.counts = trie, [], []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = number = len(self)
        return number

    def learn(self) -> np.ndarray:
        self.counts += self.trie.count([MARK + w.decode("utf-8", "surrogateescape") for w in self.new])
        self.new = []
        return np.array(self.counts or [0], np.int64)


def count_tokens(docs: DataFrame, scores: dict[str, float]) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_words, n_tokens) of the whole text.

    A null or empty text and one of separators only has no tokens.  Only ``doc_id`` and ``text`` are read;
    repeated rows give repeated rows, an empty table an empty result.  ``scores`` is broadcast: one vocabulary.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = TrieCounts(shared.value)
        known, ids, rows, size = _Numbers(trie), [], [], 0

        def flush() -> pa.RecordBatch:
            counts = known.learn()
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(r) for r in rows], pa.int64()),
                 pa.array([int(counts[r].sum()) for r in rows], pa.int64())], ["doc_id", "n_words", "n_tokens"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                words = raw.split()
                ids.append(doc_id)
                rows.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                size += len(raw)
                if size >= SLICE_BYTES:
                    yield flush()
                    known = known if len(known) < MAX_KNOWN else _Numbers(trie)
                    ids, rows, size = [], [], 0
        if ids:
            yield flush()

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, n_words long, n_tokens long"))
