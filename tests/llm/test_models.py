"""Quality classifier, decontamination, near duplicates, personal data, URL filter."""

import itertools
import random

import numpy as np
import pytest
from grovemap.llm import op6_nbsvm as op6
from grovemap.llm import op7_decontaminate as op7
from grovemap.llm import op8_simhash as op8
from grovemap.llm import op9_pii as op9
from grovemap.llm import op10_urls as op10
from grovemap.llm.common import WORD
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


# --- 6


def test_classifier_on_holdout(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0)
    model = op6.train(docs, labels.join(held.select("doc_id"), "doc_id", "left_anti"))
    rows = docs.join(held, "doc_id").select("text", "quality").collect()
    rejected = model.score([r[0] for r in rows]) < model.cutoff
    good = np.array([r[1] for r in rows]) == 1
    assert rejected[good].mean() <= 0.03
    assert rejected[~good].mean() >= 0.7


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 40, 6) + (20 if i % 2 else 0)).astype(np.int64) for i in range(60)]
    good = np.array([i % 2 == 0 for i in range(60)])
    model = op6.fit(rows, good)
    margins = np.array([model.weights[r].sum() / np.sqrt(len(r)) + model.bias for r in rows])
    assert (margins[good] > 0).mean() > 0.85 and (margins[~good] < 0).mean() > 0.85


def test_ngrams_are_distinct_and_local():
    one = {i: set() for i in range(3)}
    for a, _, doc, feature in op6.ngrams(["a b a b", None, "b a"]):
        for d, f in zip(doc, feature):
            assert f not in one[a + d]
            one[a + d].add(f)
    # a, b, ab, ba; nothing; a, b, ba
    assert len(one[0]) == 4 and not one[1] and len(one[2]) == 3 and one[2] < one[0]


def test_classifier_messy(spark, messy, nothing, labels, no_labels):
    out = op6.good_documents(messy, labels)
    assert out.columns == messy.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert {2, 3, 6} <= set(ids) and ids.count(1) in (0, 2)
    assert op6.good_documents(messy, no_labels).count() == messy.count()
    assert op6.good_documents(nothing, labels).count() == 0


# --- 7


def brute(docs, items):
    out = set()
    for (i, text), (k, item) in itertools.product(docs, items):
        d, b = WORD.findall(text.lower()), WORD.findall(item.lower())
        if len(b) < op7.SHORTEST:
            continue
        n = min(op7.PHRASE, len(b))
        hits = {(p, o) for p in range(len(d) - n + 1) for o in range(len(b) - n + 1) if d[p : p + n] == b[o : o + n]}
        for p, o in hits:
            if (p - 1, o - 1) not in hits:
                m = 0
                while (p + m, o + m) in hits:
                    m += 1
                out.add((i, k, "exact", p, o, m - 1 + n))
        terms = set(b)
        need, window = int(np.ceil(op7.SHARE * len(terms))), int(np.ceil(op7.SLACK * len(b)))
        if len(terms) >= op7.LEAST_TERMS:
            starts = [p for p, w in enumerate(d) if w in terms]
            best = max(((len(terms & set(d[p : p + window])), -p) for p in starts), default=(0, 0))
            if best[0] >= need:
                out.add((i, k, "proximity", -best[1], None, best[0]))
    return out


def test_matches_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([3, 5, 9, 14, 20])))) for k in range(25)]
    docs = []
    for i in range(60):
        parts = rng.choices(words, k=rng.randrange(0, 40))
        item = items[rng.randrange(25)][1].split()
        if i % 3 == 0:
            parts[5:5] = item
        elif i % 3 == 1:
            item.insert(len(item) // 2, "extra")
            rng.shuffle(item)
            parts[2:2] = item
        docs.append((i, ", ".join(parts).title()))
    got = op7.matches(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(r) for r in got.collect()} == brute(docs, items)


def test_passes_over_the_index_agree(spark, monkeypatch):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    one = {tuple(r) for r in op7.matches(docs, bench).collect()}
    monkeypatch.setattr(op7, "ITEMS_PER_PASS", 15)
    monkeypatch.setattr(op7, "SEGMENT_CHARS", 50_000)
    assert one and {tuple(r) for r in op7.matches(docs, bench).collect()} == one


def test_decontamination_messy(spark, messy, nothing):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog near the old river bank"), (2, None), (None, "a b c d e f"), (3, ""), (1, "quick brown fox jumps over the lazy dog near the old river bank")], "item_id long, text string").withColumn("n", F.lit(1))
    out = op7.clean_documents(messy, bench)
    assert out.columns == messy.columns
    assert sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None) == [2, 3, 5, 6, 7]
    assert out.filter("doc_id IS NULL").count() == 2
    assert op7.matches(nothing, bench).count() == 0
    assert op7.clean_documents(messy, bench.limit(0)).count() == messy.count()


def test_every_run_of_windows_against_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    items = [(k, " ".join(rng.sample(words, rng.choice([9, 14, 20])))) for k in range(8)]
    docs = []
    for i in range(30):
        parts: list[str] = []
        for _ in range(rng.randrange(1, 5)):
            item = rng.choice(items[:2])[1].split()
            rng.shuffle(item)
            parts += item + rng.choices([*words[:5], "other", "more"], k=rng.randrange(0, 30))
        docs.append((i, " ".join(parts)))
    want = set()
    for (i, text), (k, item) in itertools.product(docs, items):
        d, b = text.split(), item.split()
        need, window, best = int(np.ceil(op7.SHARE * len(b))), int(np.ceil(op7.SLACK * len(b))), None
        for p in [*(p for p, w in enumerate(d) if w in b), len(d)]:
            held = len(set(b) & set(d[p : p + window]))
            if held >= need:
                best = max(best or (0, 0), (held, -p))
            elif best:
                want.add((i, k, -best[1], best[0]))
                best = None
    found = op7.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), every=True)
    assert {(r["doc_id"], r["item_id"], r["doc_start"], r["n_tokens"]) for r in found.filter("match = 'proximity'").collect()} == want
    assert len({r[:2] for r in want}) < len(want)


def test_short_items_are_found_but_remove_nothing(spark):
    docs = spark.createDataFrame([(1, "Now: alpha beta, gamma. Alpha!"), (2, "beta gamma alpha"), (3, "one two three four five")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "Alpha Beta Gamma"), (2, "gamma alpha"), (3, "alpha"), (4, "!")], "item_id long, text string")
    assert sorted(map(tuple, op7.matches(docs, bench).drop("match", "item_start").collect())) == [(1, 1, 1, 3), (1, 2, 3, 2), (1, 3, 1, 1), (1, 3, 4, 1), (2, 2, 1, 2), (2, 3, 2, 1)]
    assert op7.clean_documents(docs, bench).count() == 3
    assert op7.clean_documents(docs, spark.createDataFrame([(1, "two three four five")], "item_id long, text string")).count() == 2


def test_windows_stay_inside_a_document_in_any_script(spark):
    words = ["".join(chr(0x430 + int(c)) for c in str(1000 + i)) for i in range(100)]
    halves = [" ".join(words[:50]), " ".join(words[50:])]
    docs = spark.createDataFrame([(i, halves[i % 2]) for i in range(20)], "doc_id long, text string").repartition(1)
    bench = spark.createDataFrame([(1, " ".join(words[::-1]))], "item_id long, text string")
    assert op7.matches(docs, bench).count() == 0
    whole = spark.createDataFrame([(1, " ".join(halves))], "doc_id long, text string")
    assert [(r["match"], r["n_tokens"]) for r in op7.matches(whole, bench).collect()] == [("proximity", 100)]


# --- 8


@pytest.mark.parametrize("radius", [0, 3, 20, 63])
def test_sliced_pairs_against_brute_force(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2, (30, 128), dtype=np.uint8)
    bits = base[rng.integers(0, 30, 300)] ^ (rng.random((300, 128)) < 0.06).astype(np.uint8)
    ends = np.repeat([70, 71, 140, 300], [70, 1, 69, 160])
    got = {(i, j) for a, b in op8.sliced_pairs(bits, ends, radius) for i, j in zip(a.tolist(), b.tolist())}
    want = {(i, j) for i in range(300) for j in range(i + 1, ends[i]) if (bits[i] != bits[j]).sum() <= radius}
    assert got == want


def test_near_pairs_recall(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    prints, ok = op8.simhash([r[1] for r in rows])
    first = {}
    for r, p, k in zip(rows, prints, ok):
        if k:
            first.setdefault(tuple(p.tolist()), r[0])
    ids = np.array(list(first.values()))
    bits = op8.bit_matrix(np.array(list(first), np.uint64))
    want = {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(len(ids)) for j in np.flatnonzero((bits[i] != bits[i + 1 :]).sum(axis=1) <= op8.RADIUS) + i + 1}
    got = {(r["a"], r["b"]) for r in op8.near_pairs(docs).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 20
    groups = {r[0]: r[1] for r in op8.near_duplicates(docs).collect()}
    root = {r[0]: groups.get(r[0], r[0]) for r in rows}
    assert np.mean([root[a] == root[b] for a, b in want]) >= 0.9
    same = {}
    for r, p, k in zip(rows, prints, ok):
        if k:
            same.setdefault(tuple(p.tolist()), set()).add(root[r[0]])
    assert all(len(s) == 1 for s in same.values())


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 160)]
    parent = list(range(200))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r[0]: r[1] for r in op8.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in range(200) if find(i) != i}


def least_members(n, pairs):
    """The least member of each one's component."""
    label = list(range(n))
    while True:
        now = list(label)
        for a, b in pairs:
            now[a] = now[b] = min(now[a], now[b])
        if now == label:
            return label
        label = now


def test_forest_against_brute_force():
    assert op8.forest(np.array([1, 2, 0]), np.array([2, 3, 3]), np.arange(4)).tolist() == [0, 0, 0, 0]
    rng = np.random.default_rng(3)
    for _ in range(100):
        n = int(rng.integers(2, 120))
        pairs = rng.integers(0, n, (int(rng.integers(1, 2 * n)), 2))
        label = np.arange(n)
        for part in np.array_split(pairs, rng.integers(1, 6)):
            label = op8.forest(part[:, 0], part[:, 1], label)
        assert label.tolist() == least_members(n, pairs.tolist())


@pytest.mark.parametrize("large", [1, 70, 300, op8.LARGE_BUCKET])
def test_compared_buckets_keep_their_components(spark, monkeypatch, large):
    rng = np.random.default_rng(8)
    bits = rng.integers(0, 2, (6, 128), dtype=np.uint8)
    for _ in range(594):
        # a copy of any earlier one, so that groups are long chains
        near = bits[rng.integers(0, len(bits))].copy()
        near[rng.permutation(128)[: rng.integers(2, 9)]] ^= 1
        bits = np.vstack([bits, near])
    names = rng.permutation(len(bits))
    prints = np.packbits(bits, axis=1).view(np.int64)
    rows = spark.createDataFrame([(i % 2, int(names[i]), *prints[i].tolist()) for i in range(len(bits))], "key long, id long, hi long, lo long").coalesce(1)
    pairs = [(int(names[i]), int(names[j])) for i in range(len(bits)) for j in np.flatnonzero((bits[i] != bits[i + 1 :]).sum(axis=1) <= 5) + i + 1 if (i - j) % 2 == 0]
    monkeypatch.setattr(op8, "LARGE_BUCKET", large)
    sent = [(r["a"], r["b"]) for r in op8.compare(rows, 5, False).collect()]
    want = least_members(len(bits), pairs)
    assert least_members(len(bits), sent) == want and len(set(want)) < len(bits) - 100


def test_near_duplicates_messy(messy, nothing):
    out = op8.keep_one(messy)
    assert out.columns == messy.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 5, 6, 7] and ids.count(None) == 2
    assert [tuple(r) for r in op8.near_duplicates(messy).collect()] == [(4, 1)]
    assert op8.near_duplicates(nothing).count() == 0 and op8.keep_one(nothing).count() == 0


def test_rows_that_share_an_id_are_told_apart(spark):
    rng = random.Random(9)
    words = [f"word{i}" for i in range(3000)]
    one, two, three, four = (" ".join(rng.sample(words, 200)) for _ in range(4))
    near = lambda text: text + " tail"
    rows = [(1, one), (5, near(one)), (5, two), (5, two), (7, near(two)), (9, three), (9, four), (9, ""), (9, None), (9, ""), (3, near(four)), (None, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("headers", F.create_map(F.lit("k"), F.lit("v")))
    left = sorted(((r["doc_id"], r["text"]) for r in op8.keep_one(docs).collect()), key=str)
    assert left == sorted([(1, one), (5, two), (9, three), (9, ""), (9, None), (3, near(four)), (None, one)], key=str)
    assert sorted(map(tuple, op8.near_duplicates(docs).collect())) == [(5, 1), (7, 5), (9, 3)]
    again = spark.createDataFrame([(1, one), (1, one + "."), (1, one.upper())], "doc_id long, text string")
    assert [r["text"] for r in op8.keep_one(again).collect()] == [one.upper()]


# --- 9


def test_gradients():
    model, rng = op9.Tagger(), np.random.default_rng(0)
    ids, tags = rng.integers(0, op9.SYMBOLS, (7, 3)), rng.integers(0, len(op9.KINDS), (7, 3))
    _, grads = model.loss(ids, tags)
    for k, p in model.p.items():
        at = (ids[2, 1], 5) if k[0] == "x" else tuple(rng.integers(0, s) for s in p.shape)
        old = p[at]
        sides = []
        for step in (1e-5, -1e-5):
            p[at] = old + step
            sides.append(model.loss(ids, tags)[0])
        p[at] = old
        assert (sides[0] - sides[1]) / 2e-5 == pytest.approx(grads[k][at], rel=1e-4, abs=1e-8)


def test_likelihood_and_decoding_against_all_paths():
    model, rng = op9.Tagger(), np.random.default_rng(1)
    model.p["wf"] *= 3
    ids = rng.integers(0, op9.SYMBOLS, (4, 1))
    paths = list(itertools.product(range(len(op9.KINDS)), repeat=4))
    chance = [np.exp(-model.loss(ids, np.array(p)[:, None])[0]) for p in paths]
    assert sum(chance) == pytest.approx(1)
    frozen = op9.Tagger()
    frozen.p = dict(model.p)
    frozen = frozen.frozen()
    e = frozen.emissions(ids[:, 0].astype(np.intp), np.array([0]), np.array([4]))
    found = dict(frozen.decode(e, np.array([4])))
    assert tuple(found.get(0, np.zeros(4)).tolist()) == paths[int(np.argmax(chance))]


@pytest.fixture(scope="module")
def tagger(spark):
    return op9.train(op9.carrier_lines(spark.read.parquet(f"{SF}/documents.parquet"), 100), steps=350)


def test_tagger_on_new_texts(spark, tagger):
    texts = op9.labelled(list(op9.carrier_lines(spark.read.parquet(f"{SF}/documents.parquet"), 60)), 300, 77)
    got = tagger.spans([t for t, _ in texts])
    right = sum(len(set(g) & set(s)) for g, (_, s) in zip(got, texts))
    assert right >= 0.9 * sum(map(len, got)) and right >= 0.9 * sum(len(s) for _, s in texts)


def test_windows_are_reconciled(tagger, monkeypatch):
    card = "4485 1234 5678 9012".replace(" ", "")
    text = ("some plain words here " * 50 + card + " ") * 6
    want = [(m, m + 16, 4) for m in range(len(text)) if text.startswith(card, m)]
    assert [s for s in tagger.spans([text])[0] if s[2] == 4] == want
    for window in (100, 128, 150):
        monkeypatch.setattr(op9, "WINDOW", window)
        assert [s for s in tagger.spans([text])[0] if s[2] == 4] == want


def test_result_does_not_depend_on_neighbours(tagger):
    texts = ["call +1 (212) 555-0199 now", None, "", "mail the.12@mail3.example.com", "x" * 3000]
    alone = [tagger.spans([t])[0] for t in texts]
    assert tagger.spans(texts) == alone and tagger.spans(texts[::-1]) == alone[::-1]


def test_personal_data_messy(messy, nothing, tagger):
    rows = op9.find(messy, tagger).collect()
    assert all(r["end"] > r["start"] for r in rows)
    assert op9.find(nothing, tagger).count() == 0
    assert op9.carrier_lines(nothing) == ()
    assert isinstance(op9.train((), steps=1), op9.Tagger)


# --- 10


def test_viterbi_against_all_splits():
    rng = random.Random(0)
    count = {"th": 50.0, "the": 90.0, "casino": 5.0, "win": 9.0, "e": 2.0, "a": 30.0, "hea": 4.0}
    for _ in range(30):
        label = "".join(rng.choices(["th", "the", "win", "a", "q"], k=4))[:9]

        def score(words):
            return sum((np.log(count[w]) if w in count else -len(w) * np.log(10)) - np.log(1000.0) for w in words)

        splits = [[label[i:j] for i, j in zip((0, *c), (*c, len(label)))] for n in range(len(label)) for c in itertools.combinations(range(1, len(label)), n)]
        assert score(op10.viterbi(label, count, 1000.0)) == pytest.approx(max(map(score, splits)))


def test_urls_are_split_and_blocked(spark):
    urls = ["https://casinowin.example.com/en/1.html", "http://m.free-bets.example.com/x", "https://cheappills.net/buy", "http://blog.thetion.example.org/en/news", "https://www.localnews.org/article/2", None, "", "/relative/only"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("x")).withColumn("part", F.lit(1))
    docs = spark.createDataFrame([(1, "the tion the tion local news blog " * 50)], "doc_id long, text string")
    got = {r["page_id"]: r for r in op10.score_urls(pages, docs).collect()}
    assert got[0]["host_words"].startswith("casino win") and "cheap pills" in got[2]["host_words"] and "the tion" in got[3]["host_words"]
    assert [got[i]["blocked"] for i in range(8)] == [True, True, True, False, False, False, False, False]


def test_large_candidate_tables_give_the_same(spark, monkeypatch):
    pages, docs = spark.read.parquet(f"{SF}/pages.parquet").limit(60), spark.read.parquet(f"{SF}/documents.parquet").limit(100)
    one = sorted(map(tuple, op10.score_urls(pages, docs).collect()))
    monkeypatch.setattr(op10, "SMALL_TABLE", 0)
    assert sorted(map(tuple, op10.score_urls(pages, docs).collect())) == one


def test_urls_messy(spark, messy, nothing):
    pages = spark.createDataFrame([(1, "http://a.b/"), (1, "http://a.b/"), (None, "http://a.b/"), (2, "x" * 5000), (3, "http://" + "ab" * 300 + ".com/")], "page_id long, url string")
    assert op10.score_urls(pages, messy).count() == 5
    assert op10.score_urls(pages, nothing).count() == 5
    assert op10.score_urls(pages.limit(0), messy).count() == 0
