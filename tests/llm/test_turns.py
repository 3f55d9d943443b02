"""Conversation repair against a plain search over edit strings."""
import hashlib
import itertools
import random
import re
import zlib

import pytest

from ledgerlark.llm import turn_repair as tr
from ledgerlark.llm.queries import op11_conversation_repair

from ..conftest import SF_SMALL

GRAMMAR = re.compile(r"(s?(ua)+)?")
FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def plain_faults(rows):
    """First fault of each (role, text) row."""
    faults, seen = [], set()
    for role, text in rows:
        marks = re.findall(r"[^\x20\x09-\x0D]", text)
        if not marks:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        elif marks[-1] not in ".!?":
            faults.append("truncated")
        else:
            faults.append("")
        seen.add((role, text))
    return faults


def plain_best(rows, faults):
    """(cost, audit) by a recursion over whole audit strings, rows taken from the front."""
    step = {"": "su", "s": "u", "u": "a", "a": "u"}
    memo = {}

    def best(i, last, inserts):
        key = i, last, inserts
        if key not in memo:
            options = [(0, "")] if i == len(rows) and last in ("", "a") else []
            if inserts < 3:
                to = "a" if last == "u" else "u"
                c, a = best(i, to, inserts + 1)
                options.append((c + 3, "I" + a))
            if i < len(rows):
                c, a = best(i + 1, last, 0)
                options.append((c + 4, "D" + a))
                if faults[i] not in ("blank", "duplicate"):
                    extra = 3 * (faults[i] == "truncated")
                    for to in step[last]:
                        c, a = best(i + 1, to, 0)
                        if rows[i][0][:1] == to:
                            options.append((c + extra, "K" + a))
                        if to != "s":
                            options.append((c + extra + 3, "R" + a))
            memo[key] = min(options) if options else (10 ** 9, "")
        return memo[key]

    return best(0, "", 0)


def apply(rows, audit):
    out, i, last = [], 0, ""
    for edit in audit:
        to = "assistant" if last == "u" else "user"
        if edit == "I":
            out.append((to, ""))
        else:
            role, text = rows[i]
            i += 1
            if edit == "D":
                continue
            out.append((role if edit == "K" else to, text))
        last = out[-1][0][:1]
    assert i == len(rows)
    return out


def plain_report(turns):
    """turns: (turn, role, text) in order."""
    rows = [(role, text) for _, role, text in turns]
    faults = plain_faults(rows)
    cost, audit = plain_best(rows, faults)
    repaired = apply(rows, audit)
    assert GRAMMAR.fullmatch("".join(r[:1] for r, _ in repaired))
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    initials = [r[:1] for r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    text = "\n".join(f"{r}:{t}" for r, t in repaired)
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256(text.encode()).hexdigest())


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def plain_all(rows, turns):
    """Reports of every conv_id of ``rows`` over its ``turns``."""
    def order(r):
        digest = hashlib.md5(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()
        return (r[0] is not None, r[0] or 0, digest)

    return {c: plain_report(sorted([r[1:] for r in turns if r[0] == c], key=order)) for c in {r[0] for r in rows}}


def test_audits_of_all_short_signatures():
    """Every signature of up to four rows, and random long ones, against the plain recursion."""
    sample = {"s": ("system", "x."), "u": ("user", "x."), "a": ("assistant", "x."), "o": ("tool", "x.")}
    letters = {**{k: (v, "") for k, v in sample.items()}, **{k.upper(): ((v[0], "x"), "truncated") for k, v in sample.items()},
               "1": (("system", ""), "blank"), "6": (("user", "x."), "duplicate")}
    stack = tr.SuffixStack()
    rng = random.Random(3)
    words = ["".join(w) for n in range(4) for w in itertools.product(letters, repeat=n)]
    words += ["".join(rng.choice("".join(letters)) for _ in range(rng.randrange(4, 40))) for _ in range(300)]
    for word in sorted(words, key=lambda w: w[::-1]):
        rows, faults = [letters[c][0] for c in word], [letters[c][1] for c in word]
        assert stack.solve(word[::-1]) == plain_best(rows, faults), word
    assert len(stack.automaton._nodes) < 400  # minimised: few nodes whatever the number of signatures


def test_no_cheaper_edit_string():
    """For two rows, all edit strings with up to four inserts: none is cheaper, none as cheap is ASCII-less."""
    for (a, b) in itertools.product([("system", "x."), ("user", "y"), ("assistant", "z."), ("tool", "t.")], repeat=2):
        rows = [a, b]
        faults = plain_faults(rows)
        found = []
        for edits in itertools.product("DKR", repeat=2):
            for inserts in itertools.product(range(4), repeat=3):
                audit = "I" * inserts[0] + edits[0] + "I" * inserts[1] + edits[1] + "I" * inserts[2]
                out = apply(rows, audit)
                if GRAMMAR.fullmatch("".join(r[:1] for r, _ in out)) and not any(
                        e in "KR" and f in ("blank", "duplicate") for e, f in zip(edits, faults)):
                    cost = 3 * audit.count("I") + 3 * audit.count("R") + 4 * audit.count("D") + 3 * sum(
                        e != "D" and f == "truncated" for e, f in zip(edits, faults))
                    found.append((cost, audit))
        assert min(found) == plain_best(rows, faults)


AWKWARD = [
    (None, 0, "user", "no id."), (None, 1, "assistant", "no id either."),
    (1, None, "user", "no turn."), (1, None, None, None), (1, 5, "assistant", "later."),
    (2, 0, "", "empty role."), (2, 1, "tool", "other role."), (2, 2, "USER", "upper case."),
    (3, 0, "user", "same."), (3, 0, "user", "same."), (3, 0, "user", "same."), (3, 1, "assistant", "same."),
    (4, 3, "user", "tie a."), (4, 3, "assistant", "tie b."), (4, 3, "user", "\t\n \x0b"),
    (5, -7, "system", "only a system prompt."), (6, 10 ** 9, "assistant", "far."), (6, 0, "user", "x\ny\n? \t\n"),
    (7, 0, "user", "long " * 200_000 + "."), (7, 1, "assistant", "é日本!" * 5000), (8, 0, "assistant", "no user."),
    (8, 1, "assistant", "cut"), (9, 0, "user", "."), (9, 1, "user", " "),
]
SCHEMA = "conv_id long, turn long, role string, text string, audit string, cost int, digest int, kind int, alive int"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], SCHEMA)


def many(n):
    rng = random.Random(n)
    texts = ["Yes.", "No!", "cut", "", " ", "Why?", "So it is."]
    return [(100 + c, t, rng.choice(["system", "user", "assistant", "user", "assistant", "tool"]), rng.choice(texts))
            for c in range(n) for t in range(rng.randrange(1, 9))]


@pytest.mark.parametrize("rows", [AWKWARD, many(120), [(1, t, ["user", "assistant"][t % 2], f"row {t}.") for t in range(3000)]],
                         ids=["awkward", "many", "one long"])
def test_report_of_damaged_turns(spark, rows):
    got = tr.repair_report(tr.damaged_turns(conversations(spark, rows)), "alive").collect()
    if len(rows) == 3000:  # too deep for the recursion: the edits must repair and cost what they say
        turns = plain_damage(rows)
        plain = [(r, t) for _, _, r, t in turns]
        faults, (row,) = plain_faults(plain), got
        assert [row[f] for f in ("blank", "duplicate", "truncated")] == [
            faults.count(f) for f in ("blank", "duplicate", "truncated")]
        repaired = apply(plain, row["audit"])
        assert GRAMMAR.fullmatch("".join(r[0] for r, _ in repaired))
        text = "\n".join(f"{r}:{t}" for r, t in repaired)
        assert row["repaired_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        return
    want = plain_all(rows, plain_damage(rows))
    assert {r["conv_id"]: tuple(r[f] for f in FIELDS) for r in got} == want and len(got) == len(want)


def test_repaired_turns_and_split_conversations(spark):
    """Rows as they are (nothing planted), with more ranges than conversations."""
    rows = AWKWARD + many(40)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        turns = conversations(spark, rows)
        report = {r["conv_id"]: r for r in tr.repair_report(turns).collect()}
        made = tr.repaired_turns(turns).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    spaced = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    want = plain_all(rows, spaced)
    assert {c: tuple(r[f] for f in FIELDS) for c, r in report.items()} == want
    for conv, row in report.items():
        mine = sorted((r for r in made if r["conv_id"] == conv), key=lambda r: r["position"])
        assert [r["position"] for r in mine] == list(range(len(mine)))
        text = "\n".join(f"{r['role']}:{r['text']}" for r in mine)
        assert hashlib.sha256(text.encode()).hexdigest() == row["repaired_sha256"]
        assert "".join(r["edit"] for r in mine) == row["audit"].replace("D", "")


def test_empty_table(spark):
    empty = conversations(spark, AWKWARD).where("conv_id = 99")
    assert tr.repair_report(tr.damaged_turns(empty), "alive").collect() == []
    assert tr.repaired_turns(empty).collect() == []


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    got = op11_conversation_repair(spark, SF_SMALL).collect()
    assert {r["conv_id"]: tuple(r[f] for f in FIELDS) for r in got} == plain_all(rows, plain_damage(rows))
