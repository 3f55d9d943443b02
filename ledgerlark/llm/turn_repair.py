"""Repair of conversation structure: the cheapest edits that give every conversation legal turns.

A conversation's rows become a signature, one letter per row that names the role's initial and the row's first
fault.  Read from the end, equal suffixes of all signatures are one path of a suffix-shared automaton; its nodes
are minimised by (letter, differences of the costs-to-go behind it), so that the cost-to-go and the first piece of
the best audit suffix are worked out once per node and grammar state, whatever the number of conversations.  The
signatures are dealt out and sorted from their ends: neighbours share their longest common suffix, and equal
signatures are walked once, however many conversations have them.

Scale: faults and signatures move without the texts.  Rows are dealt by ranges of (conversation, turn), so a
conversation that holds a large share of the rows is many tasks and its signature is put together from one part
a task.  Only the repaired texts pass by conversation, as a sorted stream that Spark spills: a task holds a batch and
the conversation's audit (a letter per edit), never its texts.  (SHA-256 of one text is sequential by definition.)

Defined results: a null role or text is one space; null turns come first; rows of equal turn are ordered by the
digest of role and text, so equal rows are adjacent; a null ``conv_id`` is a conversation of its own; an empty text is
blank; texts of any length are whole; an empty table gives no rows; other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import keep_table

SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3

#: A signature letter for each initial (system, user, assistant, other) by first fault.
SOUND, CUT, BLANK, COPY = "suao", "SUAO", "1234", "5678"
LEGAL_PAIRS = {"su", "ua", "au"}
_INITIAL = str.maketrans(CUT + BLANK + COPY, SOUND * 3)

#: Grammar ``(s?(ua)+)?``: nothing yet, after s, after u, after a.  What an inserted or re-roled row becomes.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT_ROLE = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
NEXT_STATE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEPT_STATE = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT,
              (ASSISTANT, "u"): USER}
#: Behind the last row: inserts that complete the grammar.
END_PIECE = ("", INSERT * 2, INSERT, "")
END_COST = tuple(INSERT_COST * len(p) for p in END_PIECE)

_PART = "conv_id {id}, part int, signature string, first_turn long, last_turn long, turns long"
_SOLVED = ("conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
           "audit string")
_BATCH = 4096


class RepairAutomaton:
    """Nodes of the minimised suffix automaton, made when first met.

    A node stands for a letter before a class of suffixes; a class is the vector of its costs-to-go by grammar
    state, less the cost from START.  A node keeps its own class, its cost from START beyond that of the suffix, and per
    state the piece of audit (inserts, then one edit) that the best suffix starts with, and the state behind it.
    Options that cost the same differ in their first letter, so the least letter gives the least audit.
    """

    def __init__(self):
        self._nodes: dict[tuple[tuple[int, ...], str], tuple] = {}
        self.end = END_COST

    def node(self, letter: str, behind: tuple[int, ...]) -> tuple[tuple[int, ...], int, tuple]:
        """(class, cost, ((piece, state behind), ...)) of ``letter`` before a suffix of class ``behind``."""
        key = (behind, self._folded(letter))
        if key not in self._nodes:
            self._nodes[key] = self._make(key[1], behind)
        return self._nodes[key]

    @staticmethod
    def _folded(letter: str) -> str:
        return "x" if letter in BLANK or letter in COPY else letter

    @staticmethod
    def _make(letter: str, behind: tuple[int, ...]) -> tuple[tuple[int, ...], int, tuple]:
        extra = TRUNCATED_COST if letter in CUT else 0
        best = []
        for state in range(4):
            options = [(DELETE_COST + behind[state], DELETE, state)]
            if letter != "x":
                kept = KEPT_STATE.get((state, letter.lower()))
                if kept is not None:
                    options.append((extra + behind[kept], KEEP, kept))
                moved = NEXT_STATE[state]
                options.append((extra + REROLE_COST + behind[moved], REROLE, moved))
            best.append(min(options))
        for _ in range(3):  # an insert leads to another state before the same row
            best = [min(best[s], (INSERT_COST + best[NEXT_STATE[s]][0], INSERT + best[NEXT_STATE[s]][1],
                                  best[NEXT_STATE[s]][2])) for s in range(4)]
        base = best[START][0]
        return tuple(c - base for c, _, _ in best), base, tuple((piece, to) for _, piece, to in best)


class SuffixStack:
    """The automaton's path for the suffixes of one signature; the next signature reuses what both share."""

    def __init__(self, automaton: RepairAutomaton | None = None):
        self.automaton = automaton or RepairAutomaton()
        self.letters, self.audit = "", ""
        self.steps: list[tuple] = []
        self.classes, self.costs = [self.automaton.end], [0]

    def solve(self, reversed_signature: str) -> tuple[int, str]:
        """(cost, audit) of the signature whose reverse is given."""
        if reversed_signature == self.letters:
            return self.costs[-1], self.audit
        shared = _common(self.letters, reversed_signature)
        del self.steps[shared:], self.classes[shared + 1:], self.costs[shared + 1:]
        for letter in reversed_signature[shared:]:
            cls, cost, steps = self.automaton.node(letter, self.classes[-1])
            self.steps.append(steps)
            self.classes.append(cls)
            self.costs.append(self.costs[-1] + cost)
        self.letters = reversed_signature
        pieces, state = [], START
        for steps in reversed(self.steps):
            piece, state = steps[state]
            pieces.append(piece)
        self.audit = "".join(pieces) + END_PIECE[state]
        return self.costs[-1], self.audit


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def signature_faults(signature: str) -> tuple[int, int, int, int]:
    """(blank, duplicate, truncated rows, adjacent initials that are no legal pair)."""
    kinds = [sum(signature.count(c) for c in letters) for letters in (BLANK, COPY, CUT)]
    initials = signature.translate(_INITIAL)
    legal = sum(initials.count(pair) for pair in LEGAL_PAIRS)  # two different letters cannot overlap themselves
    return kinds[0], kinds[1], kinds[2], max(len(initials) - 1, 0) - legal


# ---- Spark --------------------------------------------------------------------------------------


def damaged_turns(conversations: DataFrame) -> DataFrame:
    """Rows of ``conversations`` with a known fault planted in a quarter of them; dropped rows have ``alive`` false."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                                F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("fault"))
    fault = F.col("fault")
    text = (F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")))
    copies = F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(fault == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                       text.alias("text"), (fault != 0).alias("alive"), F.explode(copies).alias("copy")).drop("copy")


def _rows(turns: DataFrame, alive: str | None) -> DataFrame:
    lives = F.coalesce(F.col(alive), F.lit(False)) if alive else F.lit(True)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"), lives.alias("alive"))
    return rows.withColumn("digest", F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text")))


def _last_mark(text: str) -> Column:
    return F.right(F.rtrim(F.col(text), F.lit(SPACES)), F.lit(1))


def _signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, signature) of every conversation, also of those without a row that is alive."""
    initial = F.substring("role", 1, 1)
    mark = _last_mark("text")
    flat = rows.select(
        "conv_id", F.when(F.col("alive"), F.col("turn")).alias("turn"), F.when(F.col("alive"), F.col("digest")).alias("digest"),
        "alive", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
        (mark == "").alias("blank"), (~mark.isin(".", "!", "?")).alias("cut"))
    seen = Window.partitionBy("conv_id", "digest").orderBy("turn")
    letter = (F.when(~F.col("alive"), F.lit(""))
              .when(F.col("blank"), F.translate("initial", SOUND, BLANK))
              .when(F.col("n") > 1, F.translate("initial", SOUND, COPY))
              .when(F.col("cut"), F.translate("initial", SOUND, CUT)).otherwise(F.col("initial")))
    lettered = keep_table(flat.withColumn("n", F.row_number().over(seen))
                          .select("conv_id", "turn", "digest", "n", letter.alias("letter")), "turn-letters")
    order = ["conv_id", "turn", "digest", "n"]
    parts = (lettered.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "letter")
             .mapInArrow(_joined_letters, _PART.format(id=_id_type(rows))))
    s = F.array_sort(F.collect_list(F.struct("part", "signature", "first_turn", "last_turn")))
    whole = parts.groupBy("conv_id").agg(s.alias("s"), F.max("last_turn").alias("hi"), F.min("first_turn").alias("lo"),
                                         F.sum("turns").alias("turns"))
    twice = F.expr("size(filter(sequence(1, size(s)), i -> i < size(s) and s[i - 1].last_turn = s[i].first_turn))")
    return whole.select(
        "conv_id", F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("turns") + twice, F.lit(0)).cast("long").alias("gaps"),
        F.concat_ws("", F.transform("s", lambda x: x["signature"])).alias("signature"))


def _id_type(rows: DataFrame) -> str:
    return rows.schema["conv_id"].dataType.simpleString()


def _batches(records: Iterator[tuple], names: list[str], like: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Record batches of the tuples; the first column takes the id's Arrow type."""
    held: list[tuple] = []
    for record in records:
        held.append(record)
        if len(held) == _BATCH:
            yield _batch(held, names, like)
            held = []
    if held:
        yield _batch(held, names, like)


_TYPES = {"signature": pa.string(), "audit": pa.string(), "part": pa.int32(), "role": pa.string(), "text": pa.string(),
          "edit": pa.string(), "repaired_sha256": pa.string()}


def _batch(held: list[tuple], names: list[str], like: pa.DataType) -> pa.RecordBatch:
    columns = zip(*held)
    return pa.record_batch([pa.array(c, like if i == 0 else _TYPES.get(n, pa.int64()))
                            for i, (n, c) in enumerate(zip(names, columns))], names)


def _joined_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation of a sorted range: its letters in order and its distinct turns."""
    part = TaskContext.get().partitionId()
    kind = []

    def records():
        held, letters, first, last, turns = None, [], None, None, 0
        for batch in batches:
            kind[:] = [batch.column(0).type]
            for conv, turn, letter in zip(*(c.to_pylist() for c in batch.columns)):
                if held != (conv,):
                    if held:
                        yield (*held, part, "".join(letters), first, last, turns)
                    held, letters, first, last, turns = (conv,), [], None, None, 0
                letters.append(letter)
                if turn is not None and turn != last:
                    first, last, turns = turn if first is None else first, turn, turns + 1
        if held:
            yield (*held, part, "".join(letters), first, last, turns)

    yield from _typed(records(), ["conv_id", "part", "signature", "first_turn", "last_turn", "turns"], kind)


def _typed(records: Iterator[tuple], names: list[str], kind: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """``_batches`` whose id type is known once the first record is there."""
    for first in records:
        def rest(first=first):
            yield first
            yield from records
        yield from _batches(rest(), names, kind[0])
        return


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost and audit of signatures that come sorted from their ends."""
    stack, kind = SuffixStack(), []

    def records():
        held, faults = None, ()
        for batch in batches:
            kind[:] = [batch.column(0).type]
            for conv, gaps, backward in zip(*(c.to_pylist() for c in batch.columns)):
                if backward != held:
                    held, faults = backward, signature_faults(backward[::-1])
                yield (conv, gaps, *faults, *stack.solve(backward))

    yield from _typed(records(), ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"], kind)


def _audits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation."""
    known = keep_table(_signatures(rows), "turn-signatures")
    backward = F.reverse("signature")
    # the end of a signature only deals it out (bounds are drawn from it); the sort and the walk are over all of it
    return (known.select("conv_id", "gaps", backward.alias("backward"))
            .repartitionByRange(F.substring("backward", 1, 64), "conv_id").sortWithinPartitions("backward")
            .mapInArrow(_solved, _SOLVED.format(id=_id_type(rows))))


_REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _stream(rows: DataFrame) -> DataFrame:
    """Every conversation's report, then its rows in order; conversations are whole within a partition."""
    report = _audits(rows).select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"),
                                  F.lit(None).cast("string").alias("digest"), F.lit(None).cast("string").alias("role"),
                                  F.col("audit").alias("text"), *_REPORT)
    texts = rows.where("alive").select("conv_id", F.lit(1).alias("kind"), "turn", "digest", "role", "text",
                                       *[F.lit(None).cast("long").alias(c) for c in _REPORT])
    return (report.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "digest")
            .select("conv_id", "kind", "role", "text", *_REPORT))


class _Editor:
    """Applies an audit to a conversation's rows as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _inserts(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at:self.at + 1] == INSERT:
            self.at += 1
            role = NEXT_ROLE[self.state]
            self.state = NEXT_STATE[self.state]
            yield INSERT, role

    def row(self, role: str) -> Iterator[tuple[str, str]]:
        """(edit, role) of what stands before the row, then of the row itself; nothing for a deleted row."""
        yield from self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == KEEP:
            self.state = KEPT_STATE[self.state, role[:1]]
            yield KEEP, role
        elif edit == REROLE:
            role = NEXT_ROLE[self.state]
            self.state = NEXT_STATE[self.state]
            yield REROLE, role

    end = _inserts


def _edited(batches: Iterator[pa.RecordBatch], kind: list) -> Iterator[tuple]:
    """('head', conv, audit, report), ('row', edit, role, text or None) and ('end',) in order of the stream."""
    editor = None
    for batch in batches:
        kind[:] = [batch.column(0).type]
        convs, kinds, roles = (batch.column(i).to_pylist() for i in range(3))
        text = batch.column(3).cast(pa.binary() if pa.types.is_string(batch.column(3).type) else pa.large_binary())
        report = batch.select(_REPORT)
        for i, head in enumerate(kinds):
            if head == 0:
                if editor:
                    yield from (("row", *made, None) for made in editor.end())
                    yield ("end",)
                audit = text[i].as_py().decode()
                editor = _Editor(audit)
                yield "head", convs[i], audit, tuple(report.slice(i, 1).to_pylist()[0].values())
            else:
                for edit, role in editor.row(roles[i]):
                    yield "row", edit, role, None if edit == INSERT else text[i].as_buffer()
    if editor:
        yield from (("row", *made, None) for made in editor.end())
        yield ("end",)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind: list[pa.DataType] = []

    def records():
        conv, audit, report, digest, rows = None, "", (), hashlib.sha256(), 0
        for event, *what in _edited(batches, kind):
            if event == "head":
                conv, audit, report = what
                digest, rows = hashlib.sha256(), 0
            elif event == "row":
                _, role, text = what
                digest.update((f"\n{role}:" if rows else f"{role}:").encode())
                rows += 1
                if text is not None:
                    digest.update(text)
            else:
                yield (conv, *report, audit, digest.hexdigest())

    yield from _typed(records(), ["conv_id", *_REPORT, "audit", "repaired_sha256"], kind)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind: list[pa.DataType] = []

    def records():
        conv, position = None, 0
        for event, *what in _edited(batches, kind):
            if event == "head":
                conv, position = what[0], 0
            elif event == "row":
                edit, role, text = what
                yield conv, position, edit, role, "" if text is None else text.to_pybytes().decode()
                position += 1

    yield from _typed(records(), ["conv_id", "position", "edit", "role", "text"], kind)


def repair_report(turns: DataFrame, alive: str | None = None) -> DataFrame:
    """One row per conversation: faults, cost, audit and the SHA-256 of the repaired rows (``role:text`` by line).

    ``turns`` holds conv_id, turn, role, text.  Rows whose boolean column ``alive`` (if one is named) is not true are
    no rows of their conversation, which is still reported.
    """
    rows = _rows(turns, alive)
    return _stream(rows).mapInArrow(_digests, _SOLVED.format(id=_id_type(rows)) + ", repaired_sha256 string")


def repaired_turns(turns: DataFrame, alive: str | None = None) -> DataFrame:
    """The repaired rows themselves: (conv_id, position, edit, role, text); inserted rows have an empty text."""
    rows = _rows(turns, alive)
    return _stream(rows).mapInArrow(
        _repaired, f"conv_id {_id_type(rows)}, position long, edit string, role string, text string")
