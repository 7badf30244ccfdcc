"""Collocations, the Merkle manifest and license scans against brute force and DuckDB, on real texts and odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from proofloom.llm import collocations, licenses, merkle, urls
from proofloom.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", "a", None), (2, "", None, None, 0), (None, "red tape, red tape", "en", "a", 18), (None, "red tape, red tape", "en", "a", 18), (3, "RED  tape\tred\ttape. Red\ttape", None, "b", 2**62), (3, "other", None, "b", 5),
    (4, "one piece without end " * 3000, "en", "c", 1), (5, "x,y;z\nÄpfel ÄPFEL neu a\x00b", "und", "", 3), (6, "Licensed under CC BY-NC 4.0. All rights reserved.", "", "d", 9), (7, "GNU General Public License " * 400, "de", "d", 9), (-8, "cc by", "de", "", 1),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def rows(spark):
    real = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    return [*((i + 100, *rest) for i, *rest in real), *ODD]


@pytest.mark.parametrize("name", ["op11_collocations", "op12_merkle_manifest", "op13_license_index"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got, want = queries()[name](spark, SF), con.sql(oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda r: tuple(str(x) for x in r)
    at = [want.columns.index(c) for c in columns]
    rows = want.fetchall()
    assert rows and sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in rows), key=key)


# Collocations


def brute_collocations(rows, least, top, max_n=4):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(str.maketrans(UPPER, LOWER))):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang or "und" if lang is None else lang] += len(words)
            for k in range(1, max_n + 1):
                f["und" if lang is None else lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        own = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        left = []
        for p, a in own.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and inside(p, q) for q, b in own.items()):
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            left.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(left)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "limit", "bits"), [(30, 2000, 1_000_000, 2**27), (3, 7, 2000, 64), (2, 40, 300, 2**27)])
def test_collocations(spark, rows, monkeypatch, least, top, limit, bits):
    """Also with long texts in parts, with few rows held, and with a filter so small that it lets all pass."""
    if least < 30:
        rows = rows[: 40 if least == 3 else 25] + ODD
    docs = frame(spark, rows).withColumns({"phrase": F.lit("x"), "f": F.lit(1), "n": F.lit(2)})
    monkeypatch.setattr(collocations, "frequent", lambda keys, real=collocations.frequent: real(keys, bits))
    out = collocations.mined(docs, least=least, top=top).collect()
    got = sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in out)
    assert got and got == brute_collocations(rows, least, top)


def test_collocations_of_odd_inputs(spark):
    assert collocations.mined(frame(spark, [])).count() == 0
    rows = [(1, "a b c d e f. " * 40, "en", "s", 1), (2, None, None, None, None)]
    got = collocations.mined(frame(spark, rows), max_n=1).collect()
    assert got == [] and {r.phrase for r in collocations.mined(frame(spark, rows), max_n=2).collect()} == {"a b", "b c", "c d", "d e", "e f"}
    assert {r.phrase for r in collocations.mined(frame(spark, rows)).collect()} == {"a b c d", "b c d e", "c d e f"}


def test_long_texts_are_cut_at_piece_ends():
    text = "one two, three four. " * 50
    parts = [t for t, _ in collocations.parted([text, "", "x" * 500], ["en", "en", "de"], 40)]
    assert "".join(parts) == text + "x" * 500 and all(p[-1] in ".,;:!? x" for p in parts) and max(map(len, parts[:-1])) < 60


def test_runs_with_one_hash_stay_apart(monkeypatch):
    """Where hashes of unlike runs meet, each run keeps its text."""
    import pyarrow as pa

    words = collocations.Words(pa.array(["a b c a b"]), np.zeros(1, np.int64), np.ones(1, np.uint64))
    monkeypatch.setattr(collocations.Words, "keys", lambda self, at, n: np.zeros(len(at), np.uint64))
    at, _, counts = words.counted(words.runs(1), 1)
    assert words.texts(at, 1).to_pylist() == ["a", "b", "c", "a", "b"] and counts.tolist() == [1] * 5


# Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, more=0):
    doc_id, text, lang, source, n_chars = row
    n_chars = None if n_chars is None else n_chars + more
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def climbed(nodes):
    """(top, the siblings of each node up to it)."""
    proofs, at, level = [""] * len(nodes), list(range(len(nodes))), nodes
    while len(level) > 1:
        runs = [level[i : i + 2] for i in range(0, len(level), 2)]
        proofs = [p + "".join(x for j, x in enumerate(runs[a // 2]) if j != a % 2) for p, a in zip(proofs, at)]
        level, at = [sha("".join(r)) for r in runs], [a // 2 for a in at]
    return level[0], proofs


def brute_manifest(rows):
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r[2]].append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    made = {}
    for lang in langs:
        own = sorted(by_lang[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        made[lang] = (own, *climbed([leaf_of(r) for r in own]))
    root, upper = climbed([made[x][1] for x in langs]) if langs else ("", [])
    out = []
    for lang, above in zip(langs, upper):
        own, top, proofs = made[lang]
        for r, p in zip(own, proofs):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            out.append((r[0], leaf_of(r), top, root, sha(p + above), not bad))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("n", "langs"), [(0, 1), (1, 1), (2, 1), (3, 2), (65, 1), (129, 3), (64, 1), (4200, 2), (90, 70)])
def test_manifest_of_many_sizes(spark, n, langs):
    """One leaf, whole and broken runs, more than one round of blocks, and more languages than a block holds."""
    rows = [(i, f"t{i % 50}", None if i % langs == 1 else f"l{i % langs:02}", "s", i) for i in range(n)]
    got = merkle.report(frame(spark, rows), F.crc32(F.col("doc_id").cast("string")) % 7 == 0).collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in got), key=repr) == brute_manifest(rows)
    assert all((r.folded_root == r.root) == r.verified for r in got)


def test_manifest_of_odd_rows(spark, rows):
    docs = frame(spark, rows).withColumns({c: F.lit("x") for c in ("leaf", "root", "tree", "h", "r", "n", "path")})
    got = merkle.report(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 0).collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in got), key=repr) == brute_manifest(rows)


def test_paths_verify_a_leaf_alone(spark, rows):
    """A proof's own pieces: whoever holds them and a row needs no other row."""
    docs = frame(spark, rows)
    for r in merkle.proofs(merkle.manifest(docs)).limit(20).collect():
        h = r.leaf
        for x in r.path:
            assert x["pre"][64 * x["slot"] :][:64] == h
            h = sha(x["pre"][: 64 * x["slot"]] + h + x["pre"][64 * x["slot"] + 64 :])
        assert h == r.root


# Licenses


def brute_licenses(rows):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(str.maketrans(UPPER, LOWER)))
    words = [split(t) for _, t, *_ in rows]
    df = Counter(w for own in words for w in set(own))
    out = []
    places = lambda own, phrase: [i for i in range(len(own)) if own[i : i + len(phrase)] == phrase]
    for (doc_id, *_), own in zip(rows, words):
        labels, best = set(), 0.0
        for t in licenses.TEMPLATES:
            text = t.text.split()
            rare = sorted(set(text), key=lambda w: (df[w], w))[: licenses.RARE]
            weight = {q: math.log((len(rows) + 1) / (df[w] + 1)) + 1 for q, w in enumerate(text) if w in rare}
            votes = defaultdict(list)
            for p, w in enumerate(own):
                for q in weight:
                    if text[q] == w:
                        votes[p - q].append(weight[q])
            for d, found in votes.items():
                near = lambda k: any(abs(p - d - places(text, k)[0]) <= licenses.SLACK for p in places(own, k))
                if len(found) >= min(licenses.LEAST, len(weight)) and all(near(k.split()) for k in t.keys):
                    labels.add(t.label)
                    best = max(best, min(1.0, round(sum(found) / sum(weight.values()), 6)))
        base = {p: label for phrase, label in licenses.BASE.items() for p in places(own, phrase.split())}
        n_base = sum(len(places(own, phrase.split())) for phrase in licenses.BASE)
        first, last = (min(base), max(base)) if base else (None, None)
        out.append((doc_id, len(own), n_base, first, last, ",".join(sorted(set(base.values()))), ",".join(sorted(labels | set(base.values()))), max(best, licenses.BASE_SCORE if base else 0.0)))
    return sorted(out, key=repr)


GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
TEXTS = [
    GRANT, GRANT.replace("free of charge", "at no cost"), GRANT.replace("any person", "any and every person"), "x " * 500 + GRANT + " y" * 500, "MIT", "the license mit", "Released under the MIT License. " * 30,
    "Redistribution and use in source and binary forms, with or without modification, are permitted", "licensed under the GNU General Public License, version 2 or version 3", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "Licensed under CC BY-SA 4.0",
]


def test_licenses(spark, rows):
    rows = [*rows, *((1000 + i, t, "en", "s", 1) for i, t in enumerate(TEXTS))]
    docs = frame(spark, rows).withColumns({c: F.lit(1) for c in ("row", "w", "labels", "score", "hits")})
    got = sorted((tuple(r) for r in licenses.scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()), key=repr)
    want = brute_licenses(rows)
    assert [g[:7] for g in got] == [w[:7] for w in want] and [g[7] for g in got] == pytest.approx([w[7] for w in want], abs=2e-6)
    found = {g[0]: g[6] for g in got}
    assert (found[1000], found[1001], found[1003], found[1004], found[1006]) == ("mit", "", "mit", "", "mit") and found[1009] == "gpl,lgpl"
    assert licenses.scan(frame(spark, [])).count() == 0


def test_license_scan_runs_no_python(spark):
    plan = licenses.scan(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_url_rules_are_the_contracts(spark):
    """Each rule's word by the contract's own text, on its host, on a subdomain, and where a longer rule wins."""
    contract = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    said = {rule: word for word, rule in (x.split(" ") for x in contract.split(", "))}
    urls_of = [("x://net/de/", "net/de/"), ("x://a.b.net/de/8", "net/de/"), ("x://example.net/de/7", "net/de/"), ("x://www.example.net/de/81", "example.net/de/8"), ("x://com/en/", "com/en/"), ("x://example.com/en/70", "example.com/en/7"), ("x://a.org/es/x", "org/es/")]
    pages = spark.createDataFrame(list(enumerate(u for u, _ in urls_of)), "page_id long, url string")
    listed = spark.createDataFrame([("net/de/",), ("example.com/en/70",)], "key string")  # a rule's word goes before the list
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, listed).collect()}
    assert got == {i: (rule, said[rule]) for i, (_, rule) in enumerate(urls_of)}
