"""SimHash near-duplicate groups by bit-sliced comparison.

Fingerprints of 128 bits over each document's distinct words are compared
inside buckets of sampled bits. A bucket's fingerprints are held vertically,
one 64-lane word for each bit plane; one step compares a fingerprint with 64
others: the planes are XORed with its bits, eight of them at a time go through
a tree of carry-save adders into bitwise counters, and a block of lanes is
abandoned as soon as all of them exceed the radius.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grovemap.llm.common import WORD, chunks, cut, few, spread, table, tidy, without

BITS = 128
#: Largest Hamming distance of near duplicates, of 128.
RADIUS = 20
#: Probability with which a pair at the radius itself meets in a bucket; nearer pairs meet more often.
RECALL = 0.95
#: Fingerprints of a bucket from which comparisons inside one component are left out.
LARGE_BUCKET = 2048
#: Fingerprints that a bucket holds on average: many words of lanes, so that few tables do.
BUCKET = 1024
_CELLS = 1 << 15
_STEP = 8
_ONE = np.uint64(1)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def simhash(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (n x 2 uint64) and which of them are defined: texts without a word have none."""
    out, ok = np.zeros((len(texts), 2), np.uint64), np.zeros(len(texts), bool)
    for a, b in chunks(texts):
        tokens = [WORD.findall(t.lower()) if t else [] for t in texts[a:b]]
        n = np.fromiter(map(len, tokens), np.int64, b - a)
        if not n.sum():
            continue
        codes, vocabulary = pd.factorize(np.array([w for t in tokens for w in t], dtype=object))
        del tokens
        signs = np.unpackbits(np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in vocabulary), np.uint8).reshape(-1, BITS // 8), axis=1).view(np.int8) * np.int8(2) - np.int8(1)
        pairs = np.unique(np.repeat(np.arange(b - a), n) * len(vocabulary) + codes)
        doc, word = np.divmod(pairs, len(vocabulary))
        starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        sums = np.empty((len(starts), BITS), np.int32)
        ends = np.r_[starts[1:], len(doc)]
        for k in range(0, len(starts), 512):
            lo, hi = starts[k], ends[min(k + 511, len(starts) - 1)]
            sums[k : k + 512] = np.add.reduceat(signs[word[lo:hi]], starts[k : k + 512] - lo, axis=0, dtype=np.int32)
        at = doc[starts] + a
        out[at], ok[at] = np.packbits(sums > 0, axis=1).view(np.uint64).reshape(-1, 2), True
    return out, ok


def bit_matrix(prints: np.ndarray) -> np.ndarray:
    return np.unpackbits(prints.view(np.uint8).reshape(len(prints), -1), axis=1)


def planes_of(bits: np.ndarray) -> np.ndarray:
    """Vertical layout: (bits x words) uint64, lane l of word w holding fingerprint 64 w + l."""
    n = len(bits)
    padded = np.zeros((-(-n // 64) * 64, bits.shape[1]), np.uint8)
    padded[:n] = bits
    return np.packbits(np.ascontiguousarray(padded.T), axis=1, bitorder="little").copy(order="C").view(np.uint64)


def sliced_pairs(bits: np.ndarray, ends: np.ndarray, radius: int, known: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j < ends[i] within radius; rows are sorted so that a bucket is a run of rows, which for row i ends before ends[i]. known: given rows and words, which of these cells to leave out."""
    n, width = bits.shape
    planes = planes_of(bits)
    # a row's own bits as bytes of zeros or ones, which widen to such words
    masks = -np.ascontiguousarray(bits.T).view(np.int8)
    start = np.arange(1, n + 1)
    first, last = start // 64, (ends - 1) // 64
    cells = np.where(ends > start, last - first + 1, 0)
    upto = np.cumsum(cells)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(upto, (upto[row - 1] if row else 0) + _CELLS, "right")))
        many = cells[row:stop]
        q = np.repeat(np.arange(row, stop), many)
        w = np.repeat(first[row:stop], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        row = stop
        if known is not None:
            new = ~known(q, w)
            q, w = q[new], w[new]
        for s in range(0, len(q), _CELLS):
            yield from _cells(masks, planes, q[s : s + _CELLS], w[s : s + _CELLS], ends, radius, width)


def _save(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: sum and carry of three bits in each lane."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _beyond(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter, of bits from the lowest up, exceeds the radius."""
    more, same = np.zeros_like(count[0]), np.full_like(count[0], _ALL)
    for k in range(len(count) - 1, -1, -1):
        if radius >> k & 1:
            same &= count[k]
        else:
            more |= same & count[k]
            same &= ~count[k]
    return more


def _cells(masks, planes, q, w, ends, radius, width):
    """Eight planes at a time go through a tree of carry-save adders into the counters' ones, twos and fours; what leaves it, one bit of weight 8, ripples through the higher counters. After each eight the lanes beyond the radius are known, and words of which all are beyond it, or no pair, are given up."""
    low = np.maximum(q + 1 - 64 * w, 0).astype(np.uint64)
    high = np.minimum(ends[q] - 64 * w, 64)
    lanes = (_ALL << low) & np.where(high >= 64, _ALL, (_ONE << np.minimum(high, 63).astype(np.uint64)) - _ONE)
    count = [np.zeros(len(q), np.uint64) for _ in range(width.bit_length())]
    for p in range(0, width, _STEP):
        d = [planes[k][w] ^ masks[k][q].astype(np.int64).view(np.uint64) for k in range(p, p + _STEP)]
        ones, a = _save(count[0], d[0], d[1])
        ones, b = _save(ones, d[2], d[3])
        twos, e = _save(count[1], a, b)
        ones, a = _save(ones, d[4], d[5])
        count[0], b = _save(ones, d[6], d[7])
        count[1], g = _save(twos, a, b)
        count[2], carry = _save(count[2], e, g)
        for k in range(3, len(count)):
            count[k], carry = count[k] ^ carry, count[k] & carry
        if p + _STEP <= radius:
            continue
        lanes = lanes & ~_beyond(count, radius)
        alive = np.flatnonzero(lanes)
        if not len(alive):
            return
        if len(alive) < 0.8 * len(q):
            q, w, lanes, count = q[alive], w[alive], lanes[alive], [c[alive] for c in count]
    hit = np.flatnonzero(lanes)
    if len(hit):
        lane = np.unpackbits(lanes[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        r, l = np.nonzero(lane)
        yield q[hit][r], w[hit][r] * 64 + l


def bands(n: int, radius: int = RADIUS, recall: float = RECALL, bucket: int = BUCKET) -> list[np.ndarray]:
    """Bits of each bucket table for n fingerprints: as many bits as leave about `bucket` fingerprints in a bucket, in as many tables as the recall takes."""
    width = min(40, max(6, math.ceil(math.log2(max(2, n) / bucket))))
    meet = math.prod((BITS - radius - i) / (BITS - i) for i in range(width))
    tables = math.ceil(math.log(1 - recall) / math.log(1 - meet))
    rng = np.random.default_rng(7)
    return [rng.permutation(BITS)[:width] for _ in range(tables)]


def forest(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """label, which names the root of each component, after the pairs (a, b) joined components; a root is the least member."""
    while len(a):
        a, b = label[a], label[b]
        rest = a != b
        a, b = a[rest], b[rest]
        # only roots move, so that all members of a component come along
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, up := label[label]):
            label = up
    return label


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hi, lo) of each document that has an id and a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, ok = simhash(batch.column(1).to_pylist())
            ok &= ~np.asarray(batch.column(0).is_null())
            signed = prints[ok].view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), pa.array(signed[:, 0]), pa.array(signed[:, 1])], ["id", "hi", "lo"])

    return spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))).mapInArrow(tidy(run), "id long, hi long, lo long")


def bucket_rows(reps: DataFrame, sets: list[np.ndarray]) -> DataFrame:
    """(key, id, hi, lo): each fingerprint once for each table."""
    width = len(sets[0])
    powers = (1 << np.arange(width)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in (batch.slice(k, 8192) for k in range(0, batch.num_rows, 8192)):
                prints = np.stack([piece.column(1).to_numpy(), piece.column(2).to_numpy()], axis=1).view(np.uint64)
                bits = bit_matrix(prints)
                for t, chosen in enumerate(sets):
                    yield pa.RecordBatch.from_arrays([pa.array((bits[:, chosen] @ powers) + (t << width)), *piece.columns], ["key", "id", "hi", "lo"])

    return reps.mapInArrow(tidy(run), "key long, id long, hi long, lo long")


def compare(rows: DataFrame, radius: int, every: bool) -> DataFrame:
    """Pairs (a, b) within the radius in a bucket: all of them with their distance if `every`, else one spanning forest for each partition (at most as many pairs as it has documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        key, ids, hi, lo = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(4))
        del held
        order = np.lexsort((ids, key))
        key, ids, prints = key[order], ids[order], np.stack([hi[order], lo[order]], axis=1).view(np.uint64)
        ends = np.searchsorted(key, key, "right")
        bits = bit_matrix(prints)
        names, place = np.unique(ids, return_inverse=True)
        label = np.arange(len(names))
        a, b = [], []
        large = ends - np.arange(len(ends)) > LARGE_BUCKET

        def send(x, y, d):
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(d.astype(np.int32))], ["a", "b", "distance"])

        def settle():
            nonlocal label
            if a:
                label = forest(np.concatenate(a), np.concatenate(b), label)
                a.clear()
                b.clear()

        def known(q, w):
            """In large buckets, cells of 64 lanes that are all in the row's own component already: they can't change it."""
            if not large[q].any():
                return np.zeros(len(q), bool)
            settle()
            root = label[place]
            lanes = np.concatenate([root, np.repeat(root[-1:], -len(root) % 64)]).reshape(-1, 64)
            return (lanes.min(axis=1) == lanes.max(axis=1))[w] & (lanes[:, 0][w] == root[q])

        for i, j in sliced_pairs(bits, ends, radius, None if every else known):
            if every:
                yield send(np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), (bits[i] != bits[j]).sum(axis=1))
                continue
            a.append(place[i])
            b.append(place[j])
            if sum(map(len, a)) > 1_000_000:
                settle()
        settle()
        moved = np.flatnonzero(label != np.arange(len(names)))
        if len(moved):
            yield send(names[label[moved]], names[moved], np.zeros(len(moved)))

    out = rows.mapInArrow(tidy(run), "a long, b long, distance int")
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the least id of each component, for ids on an edge (a, b) that aren't it. Alternates large and small stars, which takes a logarithmic number of rounds; each is cut in the shared folder."""
    stars = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "stars")
    seen = None
    while True:
        both = stars.unionByName(stars.selectExpr("v AS u", "u AS v"))
        large = both.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u")))).filter("v > u").selectExpr("v AS u", "m AS v").distinct()
        low = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        small = low.selectExpr("explode(array(struct(u AS u, m AS v), struct(v AS u, m AS v))) AS e").selectExpr("e.u", "e.v").filter("u != v").distinct()
        stars = cut(small, "stars")
        now = stars.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == seen:
            return stars.selectExpr("u AS id", "v AS root")
        seen = now


def _distinct(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    """(id, hi, lo) of rows, and (node, hi, lo, id) of distinct fingerprints with their least id. Nodes ascend with id, so that fingerprints of one id are nodes of their own."""
    prints = cut(fingerprints(docs, id_col, text_col), "prints")
    least = prints.groupBy("hi", "lo").agg(F.min("id").alias("id"))
    reps = cut(least.orderBy("id", "hi", "lo").select(F.monotonically_increasing_id().alias("node"), "hi", "lo", "id"), "reps")
    return prints, reps, reps.count()


def _buckets(reps: DataFrame, n: int, radius: int, recall: float) -> DataFrame:
    sets = bands(n, radius, recall)
    partitions = max(int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * len(sets) // 500_000))
    return bucket_rows(reps.select(F.col("node").alias("id"), "hi", "lo"), sets).repartition(partitions, "key")


def near_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, recall: float = RECALL) -> DataFrame:
    """(a, b, distance) of all pairs of distinct fingerprints found within the radius, each fingerprint named by the least id that has it."""
    _, reps, n = _distinct(docs, id_col, text_col)
    found = compare(_buckets(reps, n, radius, recall), radius, True)
    for end in ("a", "b"):
        found = found.join(reps.select(F.col("node").alias(end), F.col("id").alias(f"{end}_id")), end).drop(end).withColumnRenamed(f"{end}_id", end)
    return found.select("a", "b", "distance")


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, recall: float = RECALL) -> DataFrame:
    """(id, hi, lo, duplicate_of) of the rows that aren't the one that stays of their group: that of the least id, and of its texts in the group that of the least fingerprint."""
    prints, reps, n = _distinct(docs, id_col, text_col)
    roots = components(compare(_buckets(reps, n, radius, recall), radius, False))
    named = roots.join(reps.select(F.col("node").alias("root"), F.col("id").alias("root_id")), "root").select(F.col("id").alias("node"), "root_id")
    to_root = reps.join(named, "node", "left").select("hi", "lo", F.coalesce("root_id", "id").alias("duplicate_of"), F.isnull("root_id").alias("first"))
    return prints.join(to_root, ["hi", "lo"]).filter("NOT first OR id != duplicate_of").select("id", "hi", "lo", "duplicate_of")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, recall: float = RECALL) -> DataFrame:
    """(doc_id, duplicate_of): each document that has a near duplicate of a smaller id, with the least id of its group.

    A group is a connected component of the pairs within the radius. Equal
    fingerprints form a group whatever their number. Rows with a null id and
    texts without a word (null, empty, punctuation only) belong to no group.
    Repeated rows of one id aren't paired with themselves; an id whose texts
    are in several groups has a row for each. An empty table gives no row;
    other columns are ignored.
    """
    return removed(docs, id_col, text_col, radius, recall).filter("id != duplicate_of").select(F.col("id").alias("doc_id"), "duplicate_of").distinct()


def _print_of(texts: pd.Series) -> pd.DataFrame:
    prints, ok = simhash(texts.tolist())
    signed = prints.view(np.int64)
    return pd.DataFrame({"hi": pd.arrays.IntegerArray(signed[:, 0].copy(), ~ok), "lo": pd.arrays.IntegerArray(signed[:, 1].copy(), ~ok)})


def keep_one(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs without near duplicates: of each group the document of the least id stays. Rows of one id are told apart by their fingerprints, or texts where these have no word; those that are equal count once. Rows with a null id stay."""
    gone = cut(removed(docs, text_col=text_col, **options).select(F.col("id").alias("_gm_id"), F.col("hi").alias("_gm_hi"), F.col("lo").alias("_gm_lo")).distinct(), "duplicates")
    again = cut(docs.groupBy(F.col("doc_id").alias("_gm_id")).count().filter("`count` > 1 AND _gm_id IS NOT NULL").select("_gm_id"), "repeated")
    if again.isEmpty():
        return without(docs, gone)
    once = without(without(docs, again), gone)
    again = few(again)
    rows = docs.join(again, docs["doc_id"] == again["_gm_id"], "left_semi").withColumn("_gm_print", F.pandas_udf(_print_of, "hi long, lo long")(F.col(text_col).cast("string")))
    left = rows.join(gone, (rows["doc_id"] == gone["_gm_id"]) & (rows["_gm_print.hi"] == gone["_gm_hi"]) & (rows["_gm_print.lo"] == gone["_gm_lo"]), "left_anti")
    # of equal rows the least stays, as far as their columns have an order
    same = Window.partitionBy("doc_id", "_gm_print.hi", "_gm_print.lo", F.when(F.isnull("_gm_print.hi"), F.col(text_col))).orderBy(text_col, *[c for c, kind in docs.dtypes if c != text_col and "map<" not in kind and "variant" not in kind])
    return once.unionByName(left.withColumn("_gm_at", F.row_number().over(same)).filter("_gm_at = 1").drop("_gm_at", "_gm_print"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
