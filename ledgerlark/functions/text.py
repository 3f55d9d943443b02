"""Text column expressions: whitespace/mojibake clean, placeholders, names."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import NAME_FOLD_FROM, NAME_FOLD_TO, PLACEHOLDER_VALUES

# Accented Latin letters folded to their base letter when normalizing column
# names (stands in for NFKD + dropping combining marks).  Fixed values.
_ACCENTS = {
    "a": "àáâãäåāăą", "c": "çćč", "d": "ď", "e": "èéêëēĕėęě", "g": "ğģ",
    "i": "ìíîïĩīĭį", "k": "ķ", "l": "ĺļľł", "n": "ñńňņ", "o": "òóôõöøōŏő",
    "r": "ř", "s": "śşš", "t": "ţť", "u": "ùúûüũūŭůűų", "y": "ýÿ", "z": "źżž",
}
ACCENT_FROM = "".join(v for v in _ACCENTS.values())
ACCENT_TO = "".join(k * len(v) for k, v in _ACCENTS.items())

# Python's whitespace set (what ``str.strip`` / ``\\s`` remove), derived by rule.
WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())
_WS_CLASS = "[" + "".join(f"\\u{ord(ch):04x}" for ch in WHITESPACE) + "]"
_WS = _WS_CLASS + "+"


def _lit_list(values):
    return [F.lit(v) for v in values]


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace
    (``btrim`` with the whitespace set: no regex)."""
    return F.btrim(c, F.lit(WHITESPACE))


def _byte_letters() -> tuple[str, str]:
    """Letters that windows-1252 or windows-1254 shows for a byte, and the Latin-1 letter of that byte."""
    shown: dict[str, str] = {}
    for codec in ("cp1252", "cp1254"):
        for byte in range(0x80, 0x100):
            letter = bytes([byte]).decode(codec, "ignore")
            if letter and letter != chr(byte):
                shown.setdefault(letter, chr(byte))
    return "".join(shown), "".join(shown.values())


SHOWN, LATIN1 = _byte_letters()
CP1252 = sum(chr(b) != bytes([b]).decode("cp1252", "ignore") != "" for b in range(0x80, 0x100))  # the first of them
#: Damage may be repeated (text read wrongly, stored and read wrongly again).
REPAIRS = 4


def fix_mojibake(c: Column) -> Column:
    """Undo UTF-8 read as Latin-1, windows-1252 or windows-1254 (``Ã§ay`` -> ``çay``, ``ÅŸeker`` -> ``şeker``).

    Only strings that hold a typical marker (cheap byte search; none is ASCII) are looked at.  Their letters go back to the bytes
    they stand for; a round counts only if every letter is one byte and the bytes are valid UTF-8.  Rounds repeat
    (up to ``REPAIRS``) until nothing changes; text without damage is never touched.
    """
    def marked(x: Column) -> Column:
        marks = [x.contains(m) for m in ("Ã", "Å", "Ä", "Â", "â€", "â\x80")]
        return reduce(or_, marks)

    def once(x: Column) -> Column:
        latin1 = F.translate(x, SHOWN, LATIN1)
        raw = F.when(~latin1.rlike("[^\\x{0000}-\\x{00FF}]"), F.encode(latin1, "ISO-8859-1"))
        return F.when(marked(x), F.coalesce(F.decode(F.try_validate_utf8(raw), "UTF-8"), x)).otherwise(x)

    rounds = F.array(*[F.lit(i) for i in range(REPAIRS)])
    return F.when((F.octet_length(c) > F.length(c)) & marked(c), F.aggregate(rounds, c, lambda x, _: once(x))).otherwise(c)


_OTHER_WS = WHITESPACE.replace(" ", "")
# single Latin-1 characters are one table lookup in a regex class; each further one would be one more test per letter
_LATIN1_WS, _WIDE_WS = ("[" + "".join(f"\\u{ord(ch):04x}" for ch in _OTHER_WS if (ch > "\xff") == wide) + "]"
                        for wide in (False, True))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once however often ``body`` names it.

    For steps that few rows need: a lambda variable keeps the generated code small (the JVM never compiles a
    method of more than 8,000 bytes), and its projection is split into methods; the body itself is interpreted.
    """
    return F.transform(F.array(value), body)[0]


def clean_text(c: Column) -> Column:
    """Mojibake repair, strip, collapse inner whitespace to one space."""
    return tidy_text(fix_mojibake(c.cast("string")))


def tidy_text(t: Column) -> Column:
    """The whitespace steps of C1.

    Whitespace characters become spaces by ``translate``, which makes a string per letter, so it runs only on
    strings that hold one; the collapse regex runs only on strings that hold a double space.
    """
    other = t.rlike(_LATIN1_WS) | ((F.octet_length(t) > F.length(t)) & t.rlike(_WIDE_WS))
    t = F.when(other, F.translate(t, _OTHER_WS, " " * len(_OTHER_WS))).otherwise(t)
    t = F.when(t.contains("  "), F.regexp_replace(t, " {2,}", " ")).otherwise(t)
    return F.trim(t)


def placeholder_key(c: Column) -> Column:
    """Lower-cased, stripped, whitespace-collapsed text used for C2."""
    return F.lower(clean_text(c))


def is_placeholder(c: Column) -> Column:
    """C2 test: NULL or a placeholder token (true for NULL)."""
    return c.isNull() | placeholder_key(c).isin(*PLACEHOLDER_VALUES)


def null_placeholders(c: Column) -> Column:
    """Cleaned text, NULL when it is a placeholder."""
    return unless_placeholder(clean_text(c))


def unless_placeholder(cleaned: Column) -> Column:
    """C2 on already cleaned text."""
    return F.when(~F.lower(cleaned).isin(*PLACEHOLDER_VALUES), cleaned)


def clean_product_name(c: Column) -> Column:
    """Clean + placeholder -> NULL + lower."""
    return F.lower(null_placeholders(c))


def normalize_name(c: Column) -> Column:
    """Column-name normalization to ``[a-z0-9 ]`` words."""
    plain = F.translate(F.lower(c), NAME_FOLD_FROM + ACCENT_FROM, NAME_FOLD_TO + ACCENT_TO)
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "\\p{M}", ""), "[^a-z0-9]+", " "))


def contains_any(c: Column, keys) -> Column:
    """1 if any keyword is a substring of ``c`` else 0 (INT)."""
    cond = F.lit(False)
    for k in keys:
        cond = cond | F.coalesce(c.contains(k), F.lit(False))
    return cond.cast("int")
