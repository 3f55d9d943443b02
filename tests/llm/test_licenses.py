"""Licence scan against a plain search of every start."""
import math
import random
import re

import duckdb
import pytest

from ledgerlark.llm import license_index as li
from ledgerlark.llm.queries import ORACLES, op12_license_scan

from ..conftest import SF_SMALL
from .helpers import awkward_texts, frame, lower, prose

FIELDS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
PATTERN = re.compile(li.WORD)


def plain_scan(texts, templates=li.TEMPLATES):
    """doc_id -> result; every start at which a key phrase can stand is tried."""
    words = {i: PATTERN.findall(lower(t)) for i, t in texts.items()}
    df = {w: sum(w in set(d) for d in words.values()) for t in templates for w in t.words}
    out = {}
    for i, doc in words.items():
        places = []
        for t in templates:
            known = sorted({w for w in t.words if df[w]}, key=lambda w: (df[w], t.words.index(w)))[:li.LOOKUPS]
            if not known:
                continue
            first, key = t.key_places[0]
            for s in [i - first for i, w in enumerate(doc) if w == key[0]]:  # elsewhere the key phrase cannot stand
                def at(q, s=s, doc=doc):
                    return doc[s + q] if 0 <= s + q < len(doc) else None
                agree = sum(at(t.words.index(w)) == w for w in known)
                keys = all(s + q >= 0 and doc[s + q:s + q + len(k)] == k for q, k in t.key_places)
                if agree >= math.ceil(li.AGREE * len(known)) and keys:
                    places.append((t, s, sum(at(q) == w for q, w in enumerate(t.words)) / len(t.words)))
        base = [s for t, s, _ in places if t.base]
        out[i] = (len(doc), len(base), min(base, default=None), max(base, default=None),
                  ",".join(sorted({t.label for t, _, _ in places if t.base})),
                  ",".join(sorted({t.label for t, _, _ in places})), max((x for *_, x in places), default=0.0))
    return out


def licensed_texts():
    rng = random.Random(11)
    texts = dict(awkward_texts())
    notices = [t.text for t in li.TEMPLATES] + ["Licensed under CC BY-NC 4.0.", "Released under the MIT License.",
                                                "GNU\tGeneral--Public\nLicense", "gnu general public licence", "ACC BY"]
    for n, notice in enumerate(notices):
        texts[100 + n] = prose(rng, 30) + " " + notice.upper() + ". " + prose(rng, 30)
        texts[200 + n] = notice
        texts[300 + n] = " ".join(notice.split()[1:]) + " " + notice.title() + "\n" + notice
    texts[400] = "MIT License " * 3000 + "license apache license license"
    texts[401] = "mıt license mİt license K cc by ccby cc0by cc by"
    texts[402] = "apache_license apache.license é-apache license日 apache license"
    texts[403] = "x " * 20_000 + "cc by"
    texts[404] = ("permission is hereby granted free of charge to any person receiving one copy of this software and "
                  "associated documentation files")
    return texts


def rows(df):
    return {r["doc_id"]: tuple(r[f] for f in FIELDS) for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][:-1] == want[i][:-1] and got[i][-1] == pytest.approx(want[i][-1]), i


def test_scan(spark):
    texts = licensed_texts()
    same(rows(li.scan_licenses(frame(spark, texts))), plain_scan(texts))


def test_repeated_rows_and_null_ids(spark):
    df = frame(spark, {1: "apache license"}, [(None, "MIT license cc by", None, None, None), (1, "apache license", "en", "a", 1)])
    got = sorted((str(r["doc_id"]), r["n_base"], r["base_labels"]) for r in li.scan_licenses(df).collect())
    assert got == [("1", 1, "apache"), ("1", 1, "apache"), ("None", 2, "cc-by,mit")]


def test_nothing_to_find(spark):
    empty = frame(spark).where("doc_id = -1")
    assert li.scan_licenses(empty).collect() == []
    plain = rows(li.scan_licenses(frame(spark, {0: "w1 w2", 1: None})))
    assert plain == {0: (2, 0, None, None, "", "", 0.0), 1: (0, 0, None, None, "", "", 0.0)}


def test_places_are_real(spark):
    texts = {1: "so licensed under the Apache License, Version 2.0 and the MIT License"}
    row = li.license_places(frame(spark, texts)).collect()[0]
    found = {(p["label"], p["start"]) for p in row["places"]}
    assert found == {("apache", 4), ("mit", 11), ("apache-2.0", 1)}


def test_native_plan(spark):
    plan = li.scan_licenses(frame(spark, licensed_texts()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan


def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = rows(op12_license_scan(spark, SF_SMALL))
    same(got, plain_scan(texts))
    assert sum(r[1] for r in got.values())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF_SMALL}/documents.parquet'")
    cur = con.execute(ORACLES["op12_license_scan"])
    names = [c[0] for c in cur.description]
    same({r[names.index("doc_id")]: tuple(r[names.index(f)] for f in FIELDS) for r in cur.fetchall()}, got)
