"""Second solvers, hot keys, held-out templates and a brute-force pipeline."""

import hashlib
import itertools
import math
import random
from collections import Counter
from pathlib import Path

import corpus_pipeline
import numpy as np
import pytest
from grovemap.llm import op1_risk_rules as op1
from grovemap.llm import op2_revisits as op2
from grovemap.llm import op3_licences as op3
from grovemap.llm import op4_mixing as op4
from grovemap.llm import op5_sharding as op5
from grovemap.llm import op6_nbsvm as op6
from grovemap.llm import op7_decontaminate as op7
from grovemap.llm import op8_simhash as op8
from grovemap.llm import op9_pii as op9
from grovemap.llm import op10_urls as op10
from grovemap.llm.common import WORD, least_hashed
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_least_hashed_counts_keys_not_rows(spark):
    hot = spark.range(3000).select(F.when(F.col("id") < 2700, 7).otherwise(F.col("id")).cast("long").alias("key"), F.col("id").cast("string").alias("v"))
    got = least_hashed(hot, "key", 20).collect()
    want = hot.select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(20).collect()
    assert sorted(r["key"] for r in got) == sorted(r["key"] for r in want) and len(got) == 20
    assert all(r["v"] == "0" for r in got if r["key"] == 7)
    assert least_hashed(hot.limit(0), "key", 20).count() == 0


# --- 1


def test_one_id_with_several_texts_counts_once(spark):
    rows = [(i, "plain words here " * 3, "en") for i in range(40)] + [(i, "### " * 20, "en") for i in range(40)]
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one = sorted(map(tuple, op1.kept(docs, labels, 0.5).collect()))
    assert one == sorted(map(tuple, op1.kept(docs.orderBy(F.desc("text")).repartition(3), labels, 0.5).collect()))


# --- 2


def test_header_names_that_differ_in_case_count_once(spark):
    rec = "record_id long, url string, ts long, kind string, etag string, last_modified string, payload_digest string, names array<string>, texts array<string>"
    rows = [(1, "http://a.b/?x=2&b=1&utm_id=3", 1, "response", '"a"', None, "p", ["X-A", "Keep", "keep"], ["0", "k", "last"]), (2, "http://a.b/?b=1&&x=2", 2, "revisit", '"a"', None, None, ["X-A", "x-a", "Content-Type"], ["1", "2", "t"])]
    got = op2.resolve(spark.createDataFrame(rows, rec).withColumn("headers", F.map_from_arrays("names", "texts"))).first()
    assert (got["canonical"], got["outcome"], got["headers"]) == ("a.b?b=1&x=2", "resolved", "keep: last\nx-a: 2")


# --- 3


@pytest.mark.parametrize(("name", "licence"), [("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0-only"), ("GPL-3", "GPL-3.0-only"), ("LGPL-2.1", "LGPL-2.1-only"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")])
def test_full_licence_texts(spark, name, licence):
    path = Path("/usr/share/common-licenses") / name
    if not path.exists():
        pytest.skip("the system has no such text")
    text = path.read_text()
    docs = spark.createDataFrame([(1, text), (2, " ".join(text.split(" ")).replace("\n", "\r\n").upper()), (3, text + "\nand one more condition")], "doc_id long, text string")
    assert {r["doc_id"]: r["licence"] for r in op3.scan(docs, op3.known_digests(spark)).collect()} == {1: licence, 2: licence, 3: None}


# --- 5


@pytest.mark.parametrize("quantiles", [3, 1000])
def test_hot_ids_are_split_and_maps_order_rows(spark, monkeypatch, quantiles):
    monkeypatch.setattr(op5, "QUANTILES", quantiles)
    rows = [(5 if i % 3 else i, "x" * (i % 50), {"k": str(i)}) for i in range(900)] + [(None, "y" * 9, {"k": str(i)}) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string,string>")
    bounds = op5.range_bounds(docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("k")), 40)
    assert max(Counter(bounds).values()) > 3 and bounds == sorted(bounds)
    got = [tuple(r) for r in op5.shard(docs, 8, 600).select("doc_id", "n_bytes", "byte_start", "shard", F.col("m")["k"]).collect()]
    assert sorted(r[4] for r in got) == sorted(r[2]["k"] for r in rows)
    again = [tuple(r) for r in op5.shard(docs.repartition(5), 8, 600).select("doc_id", "n_bytes", "byte_start", "shard", F.col("m")["k"]).collect()]
    assert sorted(got, key=str) == sorted(again, key=str)
    at = 0
    for i, n, start, _, _ in sorted(got, key=lambda r: (r[2], r[1])):
        assert start == at
        at += n
    order = [r[0] for r in sorted((r for r in got if r[1]), key=lambda r: r[2])]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))


# --- 6


def test_dual_descent_against_projected_gradient():
    rng = np.random.default_rng(3)
    n, dim = 50, 30
    at = [np.unique(rng.integers(0, dim, 8)) for _ in range(n)]
    values = [rng.normal(0, 1, len(a)) for a in at]
    y, cost = np.where(rng.random(n) < 0.5, 1.0, -1.0), rng.uniform(0.2, 2.0, n)
    w, bias, alpha = op6.dual_descent(values, at, y, cost, dim, np.random.default_rng(0), epochs=3000)
    x = np.zeros((n, dim + 1))
    for i in range(n):
        x[i, at[i]], x[i, dim] = values[i], 1.0
    primal = (w @ w + bias * bias) / 2 + (cost * np.maximum(0, 1 - y * (x[:, :dim] @ w + bias))).sum()
    q = (y[:, None] * x) @ (y[:, None] * x).T
    dual = lambda a: a.sum() - a @ q @ a / 2
    assert primal - dual(alpha) < 1e-2 * primal and primal >= dual(alpha) - 1e-9
    a = np.zeros(n)
    for _ in range(20_000):
        a = np.clip(a + (1 - q @ a) / np.linalg.norm(q, 2), 0, cost)
    assert dual(alpha) == pytest.approx(dual(a), rel=1e-3)
    assert np.concatenate([w, [bias]]) == pytest.approx((a * y) @ x, abs=0.05)


def test_order_of_rows_does_not_change_the_model(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    twice = docs.select("doc_id", "text").unionByName(docs.select("doc_id", F.reverse("text").alias("text")))
    one, two = (op6.labelled_rows(d, labels) for d in (twice, twice.repartition(7, F.rand(1))))
    assert all(np.array_equal(a, b) for a, b in zip(one[0], two[0])) and np.array_equal(one[1], two[1])


# --- 9


def _others(rng):
    """Values in layouts that training has none of."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    pick = lambda *x: rng.choice(x)
    return [
        ("email", f"{pick('anna', 'kofi', 'li')}.{pick('smith', 'baker')}.{d(2)}@{pick('ward', 'hill')}.{pick('north', 'south')}.{pick('org', 'com')}"),
        ("email", f"{pick('info', 'sales', 'jobs')}-{pick('eu', 'uk')}+{pick('a', 'x')}{d(2)}@{pick('ward', 'hill')}-{d(2)}.com"),
        ("phone", f"({d(3)}) {d(3)} {d(4)}"), ("phone", f"+{pick('49', '33')} ({d(3)}) {d(6)}"), ("phone", f"+1.{d(3)}.{d(3)}.{d(4)}"),
        ("ip", f"{pick('10', '192', '172')}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}"), ("card", f"4{d(3)}.{d(4)}.{d(4)}.{d(4)}"),
        ("secret", "gho_" + "".join(rng.choice("ABCDEFGHabcdefgh0123456789") for _ in range(36))), ("secret", "sk_test_" + "".join(rng.choice("ABCDEFGHabcdefgh0123456789") for _ in range(24))),
    ]


@pytest.fixture(scope="module")
def tagger(spark):
    return op9.train(op9.carrier_lines(spark.read.parquet(f"{SF}/documents.parquet"), 100), steps=500)


def test_tagger_on_layouts_of_other_templates(spark, tagger):
    rng = random.Random(8)
    lines = list(op9.carrier_lines(spark.read.parquet(f"{SF}/documents.parquet"), 60))
    texts, want = [], []
    for _ in range(40):
        for _, v in _others(rng):
            lead = rng.choice(lines)[:80].rstrip() + " "
            texts.append(f"{lead}{v} {rng.choice(lines)[:80]}")
            want.append((len(lead), len(lead) + len(v)))
    got = tagger.spans(texts)
    touched = sum(any(a < y and x < b for x, y, _ in g) for g, (a, b) in zip(got, want))
    covered = sum(sum(max(0, min(b, y) - max(a, x)) for x, y, _ in g) for g, (a, b) in zip(got, want))
    assert touched >= 0.9 * len(want) and covered >= 0.75 * sum(b - a for a, b in want)
    plain = [line for line in lines if len(line) > 30]
    assert sum(map(bool, tagger.spans(plain))) <= 0.03 * len(plain)
    assert tagger.spans(["write to maria-lopez+news@uni-bonn.edu today"])[0] == [(9, 38, 1)]


def test_windows_agree_with_exact_activations(tagger):
    rng, p = np.random.default_rng(0), tagger.p
    ids = [rng.integers(0, op9.SYMBOLS, n) for n in (90, 61, 60, 1)]
    sizes = np.array([len(x) for x in ids])
    e = tagger.emissions(np.concatenate(ids), np.cumsum(sizes) - sizes, sizes)
    for k, x in enumerate(ids):
        outs, _ = tagger._run(np.stack([x, x[::-1]])[:, :, None].transpose(1, 0, 2))
        exact = outs[:, 0, 0] @ p["wf"] + outs[::-1, 1, 0] @ p["wb"] + p["bias"]
        assert np.abs(e[: len(x), k] - exact).max() < 0.3
    # no window that is given up has a better path
    e = rng.normal(0, 1.5, (12, 400, len(op9.KINDS))).astype(np.float32)
    e[:, :, 0] += 2.5
    sizes = np.sort(rng.integers(1, 13, 400))[::-1]
    found = dict(tagger.decode(e, sizes))
    whole = tagger._gains
    try:
        tagger._gains = lambda e, sizes: np.ones(e.shape[1])
        every = dict(tagger.decode(e, sizes))
    finally:
        tagger._gains = whole
    assert found.keys() == every.keys() and 0 < len(every) < 400


def test_hot_ids_leave_training_lines(spark):
    docs = spark.range(3000).select(F.when(F.col("id") < 2900, 1).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("a line of words\n"), F.lit("y" * 3000), F.lit("\nmail 1")).alias("text"))
    assert len(op9.carrier_lines(docs, 10)) == 10 and set(op9.carrier_lines(docs, 10)) == {"a line of words"}


# --- 10


def test_log_odds_against_counts(spark):
    bad, good = ["http://win-win.test/win", "win.test/cash"], ["news.test/day", "https://news-day.org/win"]
    b, g = Counter("win win win win cash".split()), Counter("news day news day win".split())
    v = set(b) | set(g)
    want = {w: math.log((b[w] + 1) / (sum(b.values()) + len(v) + 1)) - math.log((g[w] + 1) / (sum(g.values()) + len(v) + 1)) for w in v}
    assert op10.train(bad, good) == pytest.approx(want)
    table = spark.createDataFrame([(u, True) for u in bad] + [(u, False) for u in [*good, bad[0]]] + [(None, True), ("x", None)], "url string, bad boolean")
    assert op10.labelled_urls(table) == ([bad[1]], sorted([*good, bad[0]]))
    pages = spark.createDataFrame([(1, "http://www.news.org/win"), (2, "http://cash.org/")], "page_id long, url string")
    odds = {r["page_id"]: r["log_odds"] for r in op10.score_urls(pages, spark.createDataFrame([(1, "news cash win")], "doc_id long, text string"), odds=want).collect()}
    prior = math.log(op10.PRIOR_BAD / (1 - op10.PRIOR_BAD))
    assert odds == pytest.approx({1: prior + want["news"] + want["win"], 2: prior + want["cash"]}, abs=1e-6)


def test_words_of_any_length_and_runs_that_are_no_host_names(spark):
    docs = spark.createDataFrame([(1, "versicherungsgesellschaften und vergleich " * 50)], "doc_id long, text string")
    pages = spark.createDataFrame([(1, "http://versicherungsgesellschaftenvergleich.de/"), (2, "data:" + "ab" * 200_000)], "page_id long, url string")
    got = {r["page_id"]: r["host_words"] for r in op10.score_urls(pages, docs).collect()}
    assert got[1] == "versicherungsgesellschaften vergleich" and len(got[2]) >= 400_000


# --- pipeline


def _components(n, pairs):
    root = list(range(n))
    for a, b in pairs:
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)
    for i in range(n):
        while root[root[i]] != root[i]:
            root[i] = root[root[i]]
    return root


def _spoils(text, item):
    """Whether the document goes: a proximity window, or a long enough exact run."""
    d, b = WORD.findall(text.lower()), WORD.findall(item.lower())
    if len(b) <= op7.CHANCE_ITEM:
        return False
    runs = [0] * (len(b) + 1)
    longest = 0
    for w in d:
        runs = [0] + [runs[k] + 1 if w == b[k] else 0 for k in range(len(b))]
        longest = max(longest, max(runs))
    if longest >= min(op7.PHRASE, len(b)) and (longest > op7.CHANCE_RUN or longest >= op7.SHARE * len(b)):
        return True
    terms, window = set(b), math.ceil(op7.SLACK * len(b))
    return len(terms) >= op7.LEAST_TERMS and any(len(terms & set(d[p : p + window])) >= math.ceil(op7.SHARE * len(terms)) for p, w in enumerate(d) if w in terms)


def test_pipeline_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    model = op6.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))

    def score(text):
        _, _, _, features = next(op6.ngrams([text]))
        return sum(float(model.weights[f]) for f in features) / math.sqrt(max(1, len(features))) + (model.bias if len(features) else 0.0)

    docs = sorted(r for r in docs if model is None or score(r[1]) - model.cutoff >= -1e-6)
    prints = [None if not ok[0] else int.from_bytes(p.tobytes(), "big") for p, ok in (op8.simhash([r[1]]) for r in docs)]
    near = [(i, j) for i, j in itertools.combinations(range(len(docs)), 2) if prints[i] is not None and prints[j] is not None and (prints[i] ^ prints[j]).bit_count() <= op8.RADIUS]
    docs = [r for r, root, i in zip(docs, _components(len(docs), near), range(len(docs))) if root == i]
    items = [r[0] for r in spark.read.parquet(f"{d}/benchmark.parquet").select("text").collect()]
    docs = [r for r in docs if not any(_spoils(r[1] or "", x) for x in items)]
    tokens = Counter()
    for r in docs:
        tokens[r[3]] += len((r[1] or "").split())
    share = {s: op4.WEIGHTS.get(s, op4.DEFAULT_WEIGHT) for s in tokens if tokens[s]}
    out = []
    for r in docs:
        rate = share[r[3]] / sum(share.values()) * sum(tokens.values()) / tokens[r[3]]
        draw = int(hashlib.md5(f"{op4.SEED}:{r[0]}".encode()).hexdigest()[:8], 16) / 2**32
        out += [r] * (int(rate) + (draw < rate - int(rate)))
    total, at, want = sum(len((r[1] or "").encode()) for r in out), 0, []
    for r in out:
        n = len((r[1] or "").encode())
        want.append((*r, n, at, min(op5.SHARDS - 1, at * op5.SHARDS // total)))
        at += n
    got = corpus_pipeline.run(spark, d).select("doc_id", "text", "lang", "source", "n_chars", "n_bytes", "byte_start", "shard").collect()
    assert len(want) > 50 and sorted(map(tuple, got), key=str) == sorted(want, key=str)
