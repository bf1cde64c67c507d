"""Quality rules, revisits, licences, mixing and sharding."""

import hashlib
import math
import random

import pytest
from grovemap.llm import op1_risk_rules as op1
from grovemap.llm import op2_revisits as op2
from grovemap.llm import op3_licences as op3
from grovemap.llm import op4_mixing as op4
from grovemap.llm import op5_sharding as op5
from pyspark.sql import functions as F


# --- 1


def test_binomial_tail_is_exact():
    for n, k, p in [(10, 3, 0.2), (40, 0, 0.05), (100, 12, 0.1)]:
        assert math.exp(op1.log_binomial_tail(k, n, p)) == pytest.approx(sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)))


def test_rules_reject_only_what_is_certified(spark):
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(4000):
        bad = i % 4 == 0
        lang = "en" if i < 3600 else "fr"
        rows.append((i, " ".join((w + "###" if bad else w) for w in rng.choices(["plain", "words", "stand", "here"], k=20)), lang))
        marks.append((i, int(not bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, quality int")
    got = {r[0] for r in op1.kept(docs, labels).collect()}
    # every good document stays; bad ones go where the stratum has enough evidence
    assert all(i in got for i, good in marks if good)
    assert not any(i in got for i, good in marks if not good and i < 3600)
    assert all(i in got for i in range(3600, 4000))


def test_thresholds_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, "x", *[rng.random() ** 3 if i % 3 else min(1.0, rng.random() + 0.3) for _ in op1.RULES]) for i in range(3000)]
    good = {i: int(i % 3 != 0) for i in range(3000)}
    df = spark.createDataFrame(rows, "id long, stratum string, " + ", ".join(f"{r} double" for r in op1.RULES))
    got = {(r["rule"], r["cutoff"]) for r in op1.thresholds(df, spark.createDataFrame(list(good.items()), "doc_id long, quality int")).collect()}
    want = set()
    n = sum(good.values())
    for at, rule in enumerate(op1.RULES):
        best = None
        for c in op1.CUTOFFS:
            k = sum(good[r[0]] for r in rows if r[2 + at] > c)
            out = sum(1 - good[r[0]] for r in rows if r[2 + at] > c)
            p = sum(math.comb(n, j) * op1.ALPHA**j * (1 - op1.ALPHA) ** (n - j) for j in range(k + 1)) if k < n * op1.ALPHA else 1
            if p <= op1.DELTA / (len(op1.RULES) * len(op1.CUTOFFS)) and out > k and (best is None or (out - k, c) >= best):
                best = (out - k, c)
        if best:
            want.add((rule, best[1]))
    assert got == want


def test_rules_on_messy_tables(messy, nothing, labels, no_labels):
    assert op1.kept(messy, labels).count() == messy.count()
    assert op1.kept(messy, no_labels).count() == messy.count()
    assert op1.kept(nothing, labels).count() == 0


# --- 2


def test_canonical_urls(spark):
    urls = ["HTTP://WWW.Example.com:80/A/?utm_source=x&b=1&ref=y#top", "https://example.com/A?b=1", "http://example.com/A/", None, "", "http://example.com/?utm_a=1&c=2"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(op2.canonical_url(F.col("u"))).collect()]
    assert got == ["example.com/A?b=1", "example.com/A?b=1", "example.com/A", None, "", "example.com?c=2"]


REC = "record_id long, url string, ts long, kind string, etag string, last_modified string, payload_digest string, headers map<string,string>"


@pytest.mark.parametrize("span", [7, op2.SPAN_SECONDS])
def test_revisits_against_brute_force(spark, span):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        kind = rng.choice(["response", "revisit"])
        tag = rng.choice([None, '"a"', 'W/"a"', '"b"'])
        rows.append((i, f"http://h{rng.randrange(6)}.com/", rng.randrange(60), kind, tag, rng.choice([None, "d1", "d2"]), f"p{i}" if kind == "response" else None, {"X": str(i), "Content-Type": str(i)}))
    rows += [rows[5], rows[5]]
    got = sorted(map(tuple, op2.resolve(spark.createDataFrame(rows, REC), span).select("record_id", "outcome", "response_id", "payload_digest", "headers").collect()), key=str)
    want = []
    for r in rows:
        if r[3] != "revisit":
            continue
        before = [x for x in rows if x[3] == "response" and x[1] == r[1] and x[2] < r[2]]
        bare = lambda t: t.removeprefix("W/") if t else t
        if not before:
            want.append((r[0], "no_response", None, None, None))
            continue
        x = max(before, key=lambda x: (x[2], x[0]))
        if r[4]:
            outcome = "resolved" if bare(r[4]) == bare(x[4]) else "etag_differs"
        elif r[5]:
            outcome = "resolved" if r[5] == x[5] else "date_differs"
        else:
            outcome = "no_validator"
        ok = outcome == "resolved"
        want.append((r[0], outcome, x[0], x[6] if ok else None, f"content-type: {x[0]}\nx: {r[0]}" if ok else None))
    assert got == sorted(want, key=str)


def test_revisits_messy(spark):
    rows = [(1, None, 1, "response", '"a"', None, "p", None), (2, None, 2, "revisit", '"a"', None, None, None), (3, "http://a.b/", None, "revisit", '"a"', None, None, None), (4, "http://a.b/", 3, "response", '"a"', None, "q", None), (5, "http://a.b/", 3, "revisit", '"a"', None, None, {"A": None}), (6, "http://a.b/", 4, "revisit", '"a"', None, None, {"A": None}), (7, "http://a.b/", 5, None, None, None, None, None)]
    df = spark.createDataFrame(rows, REC).withColumn("r", F.lit(1)).withColumn("canonical", F.lit("x"))
    got = {r["record_id"]: (r["outcome"], r["headers"]) for r in op2.resolve(df).collect()}
    assert got == {2: ("no_response", None), 3: ("no_response", None), 5: ("no_response", None), 6: ("resolved", "a: ")}
    assert op2.resolve(spark.createDataFrame([], REC)).count() == 0
    pages = spark.createDataFrame([(1, None, None), (None, "http://x.y/", "z"), (2, "http://x.y/", "h" * 100_000)], "page_id long, url string, html string")
    assert op2.resolve(op2.records(pages)).count() == 3


# --- 3


def test_licences_in_other_dress(spark):
    known = op3.known_digests(spark)
    rows = []
    for i, (name, text) in enumerate(op3.KNOWN):
        rows.append((i, "Copyright (c) 2019 Someone\n\n" + text.upper().replace("LICENSE", "LICENCE").replace(". ", " .  ").replace(",", " ;"), name))
    got = {r["doc_id"]: r["licence"] for r in op3.scan(spark.createDataFrame(rows, "doc_id long, text string, licence string"), known).collect()}
    # names differ only where two licences share a text
    assert [got[i] for i, _, _ in rows] == [name for _, _, name in rows]


def test_lines_count_only_if_entire(spark):
    docs = spark.createDataFrame([(1, "Some words.\nReleased under the MIT Licence!\nmore"), (2, "It is Released under the MIT License. indeed"), (3, "LICENSED UNDER CC BY-NC 4.0\nreleased under the mit license")], "doc_id long, text string")
    got = {r["doc_id"]: (r["licence"], r["notices"]) for r in op3.scan(docs, op3.known_digests(spark)).collect()}
    assert got == {1: (None, "MIT"), 2: (None, ""), 3: (None, "CC-BY-NC-4.0,MIT")}


def test_licences_messy(spark, messy, nothing):
    known = op3.known_digests(spark)
    got = op3.scan(messy, known).collect()
    assert len(got) == 9 and all(r["licence"] is None and r["notices"] == "" for r in got)
    assert {r["doc_id"] for r in got if r["digest"] is None} == {2, None}
    assert op3.scan(nothing, known).count() == 0


def test_copyright_lines_without_a_year_in_front(spark):
    known = op3.known_digests(spark)
    mit, bsd = (next(t for name, t in op3.KNOWN if name == x) for x in ("MIT", "BSD-3-Clause"))
    heads = ["Copyright (c) Microsoft Corporation.", "Copyright (c) The Authors", "Copyright Jane Doe 2020", " * Copyright Jane Doe, 2018-2020. All rights reserved.", "© Some Company", "(c) Jane Doe 2020"]
    rows = [(i, f"{head}\n\n{text}") for i, (head, text) in enumerate((h, t) for t in (mit, bsd) for h in heads)]
    got = {r["doc_id"]: r["licence"] for r in op3.scan(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()}
    assert [got[i] for i, _ in rows] == ["MIT"] * len(heads) + ["BSD-3-Clause"] * len(heads)
    stay = ["copyright notice, this list of conditions", "copyright holders and contributors as is", "copyright notice of 2020", "copyright holder of 2020", "(a) one\n(b) two\n(c) three"]
    kept = spark.createDataFrame([(i, "before\n" + x) for i, x in enumerate(stay)], "i int, text string").select("i", op3.canonical(F.col("text")).alias("t")).orderBy("i").collect()
    assert [r["t"].replace(" ", "") for r in kept] == ["before\n" + "".join(c for c in x if c.isalnum() or c == "\n") for x in stay]


# --- 4


def test_mixture_against_brute_force(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 3}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {"s0": 3.0, "s1": 0.2}
    got: dict[int, int] = {}
    for r in op4.mix(docs, weights, copy_col="copy_no").collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    tokens = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in ("s0", "s1", "s2")}
    share = {"s0": 3.0, "s1": 0.2, "s2": 1.0}
    for i, _, s in rows:
        rate = share[s] / 4.2 * sum(tokens.values()) / tokens[s]
        draw = int(hashlib.md5(f"{op4.SEED}:{i}".encode()).hexdigest()[:8], 16) / 2**32
        assert got.get(i, 0) == int(rate) + (draw < rate - int(rate))
    again = op4.mix(docs.repartition(7), weights).groupBy("doc_id").count().collect()
    assert {r[0]: r[1] for r in again} == got


def test_mixture_messy(messy, nothing):
    out = op4.mix(messy, copy_col="copy_no")
    assert sorted(out.columns) == sorted(messy.columns)
    rows = out.collect()
    assert {r["doc_id"] for r in rows} <= {1, 2, 3, 4, 5, 6, 7, None}
    # the null source has no token, hence rate 0; repeated rows are drawn alike
    assert not any(r["source"] is None for r in rows)
    assert sum(r["doc_id"] == 1 for r in rows) % 2 == 0
    assert op4.mix(nothing).count() == 0


# --- 5


@pytest.mark.parametrize("range_bytes", [200, 10**9])
def test_shards_against_brute_force(spark, range_bytes):
    rng = random.Random(2)
    rows = [(rng.randrange(-50, 200), "é" * rng.randrange(0, 30)) for _ in range(300)]
    got = sorted(map(tuple, op5.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8, range_bytes).select("doc_id", "n_bytes", "byte_start", "shard").collect()), key=lambda r: (r[0], r[2], r[1]))
    total, at = sum(2 * len(t) for _, t in rows), 0
    assert [r[0] for r in got] == sorted(r[0] for r in rows)
    for i, n, start, shard in got:
        assert (start, shard) == (at, min(7, at * 8 // total))
        at += n
    assert at == total
    sizes = [sum(r[1] for r in got if r[3] == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 2 * 60


def test_shards_messy(messy, nothing):
    out = op5.shard(messy, 4, 1000)
    assert len(set(out.columns)) == len(out.columns) and set(out.columns) == set(messy.columns) | {"n_bytes", "byte_start"}
    rows = out.collect()
    assert len(rows) == messy.count() and all(0 <= r["shard"] < 4 for r in rows)
    assert min(r["byte_start"] for r in rows if r["doc_id"] is not None) == max(r["byte_start"] + r["n_bytes"] for r in rows if r["doc_id"] is None)
    assert op5.shard(nothing).count() == 0
