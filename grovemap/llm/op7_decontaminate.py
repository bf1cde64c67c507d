"""Benchmark decontamination over a distributed positional inverted index.

Training tokens are stored as index segments: for each some million characters
of documents the sorted term hashes, their counts, and for each term the
ascending places of its tokens. Benchmark phrases are looked up from their
rarest term: its places, less the term's offset in the phrase, are intersected
with those of the next rarer one, and so on. Runs of matching phrases on one
diagonal make exact matches; windows that hold most of an item's terms in any
order make proximity matches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovemap.llm.common import WORD, chunks, cut, spread, table, tidy, without

#: Tokens of a phrase; shorter items of at least SHORTEST tokens are one phrase.
PHRASE = 8
SHORTEST = 1
#: A proximity window is this much longer than the item, and holds this share of its distinct terms.
SLACK = 1.25
SHARE = 0.8
#: Least distinct terms of an item for a proximity match.
LEAST_TERMS = 8
#: Longest exact run, in tokens, that counts as chance when documents are removed.
CHANCE_RUN = 12
#: Longest item, in tokens, that counts as chance when documents are removed.
CHANCE_ITEM = 3
#: Benchmark items looked up in one pass over the index; more take more passes.
ITEMS_PER_PASS = 20_000
#: Characters of documents in an index segment.
SEGMENT_CHARS = 4_000_000
_SCHEMA = "segment long, ids binary, starts binary, terms binary, counts binary, places binary"


def terms_of(text: str | None) -> list[int]:
    return [xxhash.xxh3_64_intdigest(w) for w in WORD.findall(text.lower())] if text else []


def _shuffled(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unshuffled(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of each text, counted as the index counts them."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([len(terms_of(t)) for t in batch.column(0).to_pylist()], pa.int64())], ["n"])


def build_segment(ids: np.ndarray, texts: list[str | None], gap: int) -> tuple[bytes, ...] | None:
    tokens = [WORD.findall(t.lower()) if t else [] for t in texts]
    n = np.fromiter(map(len, tokens), np.int64, len(tokens))
    if not n.sum():
        return None
    codes, vocabulary = pd.factorize(np.array([w for t in tokens for w in t], dtype=object))
    del tokens
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary), np.uint64, len(vocabulary))
    rank = np.empty(len(hashes), np.int64)
    by_hash = np.argsort(hashes)
    rank[by_hash] = np.arange(len(hashes))
    codes = rank[codes].astype(np.uint32)
    # a gap between documents keeps phrases and windows from reaching over their ends
    starts = np.cumsum(n + gap) - (n + gap)
    where = np.arange(n.sum()) + np.repeat(np.arange(len(n)) * gap, n)
    order = np.argsort(codes, kind="stable")
    counts = np.bincount(codes, minlength=len(hashes))
    ascending = where[order]
    delta = np.diff(ascending, prepend=0)
    first = np.cumsum(counts) - counts
    delta[first] = ascending[first]
    return ids.astype("<i8").tobytes(), starts.astype("<i8").tobytes(), hashes[by_hash].tobytes(), counts.astype("<u4").tobytes(), zstandard.ZstdCompressor(level=1).compress(_shuffled(delta))


class Segment:
    def __init__(self, ids: bytes, starts: bytes, terms: bytes, counts: bytes, places: bytes):
        self.ids, self.starts, self.terms = np.frombuffer(ids, "<i8"), np.frombuffer(starts, "<i8"), np.frombuffer(terms, np.uint64)
        self.counts = np.frombuffer(counts, "<u4").astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.delta = _unshuffled(zstandard.ZstdDecompressor().decompress(places))
        self.read: dict[int, np.ndarray] = {}

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Row of each term, or -1."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == terms, at, -1)

    def places(self, row: int) -> np.ndarray:
        found = self.read.get(row)
        if found is None:
            found = self.read[row] = np.cumsum(self.delta[self.first[row] : self.first[row] + self.counts[row]], dtype=np.int64)
        return found

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, "right") - 1


class Items:
    """The items of a pass, with their phrases and distinct terms end to end, so that a segment tells at once which of them can occur in it."""

    def __init__(self, items: list[Item]):
        self.items = items
        self.by_size: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for size in sorted({x.size for x in items}):
            own = [k for k, x in enumerate(items) if x.size == size]
            self.by_size.append((np.concatenate([np.full(len(items[k].phrases), k) for k in own]), np.concatenate([np.arange(len(items[k].phrases)) for k in own]), np.concatenate([items[k].phrases for k in own])))
        self.rare = np.concatenate([x.rare for x in items]) if items else np.zeros(0, np.int64)
        self.first = np.cumsum([0, *(len(x.rare) for x in items)])[:-1]
        self.need = np.array([x.need for x in items])

    def phrases(self, rows: np.ndarray) -> Iterator[tuple[Item, list[int]]]:
        """Items with the phrases of which all terms occur; rows: of each term, or -1."""
        for owner, number, terms in self.by_size:
            # from the rarest term on, as most phrases fail there
            left = np.flatnonzero(rows[terms[:, 0]] >= 0)
            left = left[(rows[terms[left]] >= 0).all(axis=1)]
            if len(left):
                cuts = np.flatnonzero(np.diff(owner[left])) + 1
                for part in np.split(left, cuts):
                    yield self.items[owner[part[0]]], number[part].tolist()

    def windows(self, rows: np.ndarray) -> Iterator[Item]:
        """Items of whose distinct terms enough occur for a proximity window."""
        if len(self.items):
            for k in np.flatnonzero(np.add.reduceat((rows[self.rare] >= 0).astype(np.int64), self.first) >= self.need).tolist():
                yield self.items[k]


class Item:
    """A benchmark item: its terms as numbers into the pass's term list, and the order in which to intersect them."""

    def __init__(self, item_id: int, terms: list[int], number: dict[int, int], frequency: np.ndarray):
        self.id, self.terms = item_id, np.array([number[t] for t in terms])
        self.size = size = min(PHRASE, len(terms))
        parts = np.lib.stride_tricks.sliding_window_view(self.terms, size)
        self.offsets = np.argsort(frequency[parts], axis=1, kind="stable")
        self.phrases = np.take_along_axis(parts, self.offsets, axis=1)
        distinct = np.unique(self.terms)
        self.rare = distinct[np.lexsort((distinct, frequency[distinct]))]
        self.need = math.ceil(SHARE * len(distinct))
        self.window = math.ceil(SLACK * len(terms))


def phrase_starts(segment: Segment, rows: np.ndarray, terms: list[int], offsets: list[int]) -> np.ndarray:
    """Places at which the phrase begins: offset-adjusted intersection from the rarest term."""
    found = None
    for t, o in zip(terms, offsets):
        if rows[t] < 0:
            return np.zeros(0, np.int64)
        places = segment.places(rows[t])
        if found is None:
            found = places - o
        elif len(places) <= 4 * len(found):
            found = np.intersect1d(found, places - o, assume_unique=True)
        else:
            at = np.minimum(np.searchsorted(places, found + o), len(places) - 1)
            found = found[places[at] == found + o]
        if not len(found):
            return found
    return found


def exact_matches(segment: Segment, rows: np.ndarray, item: Item, phrases: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """(document, start in it, start in the item, tokens) of the longest runs of the phrases."""
    hits: dict[int, list[int]] = {}
    for k in phrases:
        for p in phrase_starts(segment, rows, item.phrases[k].tolist(), item.offsets[k].tolist()).tolist():
            hits.setdefault(p - k, []).append(k)
    for diagonal, ks in hits.items():
        run = [ks[0], ks[0]]
        for k in [*ks[1:], None]:
            if k is not None and k == run[1] + 1:
                run[1] = k
                continue
            doc = int(segment.document(np.array([diagonal + run[0]]))[0])
            yield doc, int(diagonal + run[0] - segment.starts[doc]), run[0], run[1] - run[0] + item.size
            run = [k, k]


def proximity_matches(segment: Segment, rows: np.ndarray, item: Item, every: bool) -> Iterator[tuple[int, int, int]]:
    """(document, start, terms) of the best window of each run, or without `every` of each document: `item.need` or more of the item's distinct terms within `item.window` tokens. Windows start with one of the terms; a run is a longest sequence of good ones without another start between them. Of equally good windows the first counts.

    A window may lack `miss` terms, so that of the miss + k rarest it holds k: anchors are places with k of them near.
    """
    total = len(item.rare)
    if total < LEAST_TERMS:
        return
    present = rows[item.rare] >= 0
    if present.sum() < item.need:
        return
    miss, window = total - item.need, item.window
    k = min(3, item.need)
    rare = [t for t in item.rare[: miss + k] if rows[t] >= 0]
    if len(rare) < k:
        return
    lists = [segment.places(rows[t]) for t in rare]
    at = np.sort(np.concatenate(lists))
    near = np.flatnonzero(at[k - 1 :] - at[: len(at) - k + 1] < window)
    if not len(near):
        return
    # every good window holds k anchors that stand together, so that it starts less than a window before one of them
    places = [segment.places(rows[t]) for t in item.rare if rows[t] >= 0]
    spans: list[list[int]] = []
    for a in at[near].tolist():
        if spans and a - window < spans[-1][1]:
            spans[-1][1] = a + window
        else:
            spans.append([a - window + 1, a + window])
    best: dict[tuple[int, int], tuple[int, int]] = {}
    run = 0
    for lo, hi in spans:
        inside = [p[np.searchsorted(p, lo) : np.searchsorted(p, hi)] for p in places]
        if sum(map(bool, map(len, inside))) < item.need:
            continue
        starts = np.unique(np.concatenate(inside))
        held = sum(((np.searchsorted(p, starts + window) - np.searchsorted(p, starts)) > 0).astype(int) for p in inside if len(p))
        # a run never reaches into the next span: the terms that a good window holds after its start are in its own
        run += 1
        for s, h in zip(starts.tolist(), held.tolist()):
            if h < item.need:
                run += 1
                continue
            group = int(segment.document(np.array([s]))[0]), run * every
            now = best.get(group)
            if now is None or (-h, s) < (-now[0], now[1]):
                best[group] = (h, s)
    for (doc, _), (h, s) in best.items():
        yield doc, int(s - segment.starts[doc]), h


def index(docs: DataFrame, gap: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: a row for each segment. gap: free places between documents, at least the longest window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0

        def flush():
            nonlocal ids, texts, held, serial
            built = build_segment(np.array(ids, np.int64), texts, gap) if ids else None
            ids, texts, held = [], [], 0
            if built:
                serial += 1
                yield pa.RecordBatch.from_arrays([pa.array([serial - 1]), *(pa.array([x], pa.binary()) for x in built)], ["segment", "ids", "starts", "terms", "counts", "places"])

        for batch in batches:
            keys, values = batch.column(0).to_pylist(), batch.column(1)
            for a, b in chunks(values.to_pylist(), SEGMENT_CHARS // 4):
                part = values.slice(a, b - a).to_pylist()
                for i, t in zip(keys[a:b], part):
                    if i is not None and t:
                        ids.append(i)
                        texts.append(t)
                        held += len(t)
                if held >= SEGMENT_CHARS:
                    yield from flush()
        yield from flush()

    return spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))).mapInArrow(tidy(run), _SCHEMA)


def term_counts(stored: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """Tokens of each wanted term in the whole index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                terms, counts = np.frombuffer(terms, np.uint64), np.frombuffer(counts, "<u4")
                at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
                total += np.where(terms[at] == wanted, counts[at], 0)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["term", "n"])

    out = np.zeros(len(wanted), np.int64)
    found = stored.select("terms", "counts").mapInArrow(tidy(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out[found["term"].to_numpy()] = found["n"].to_numpy()
    return out


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: bool = False, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, item_id, match, doc_start, item_start, n_tokens): exact runs and proximity windows of benchmark items in documents.

    match 'exact': n_tokens tokens from doc_start on equal those of the item
    from item_start on; runs are maximal and have PHRASE tokens, or the whole
    item if that is shorter (items under `shortest` tokens are left out). match
    'proximity': the best window of each document and item, or with `every` of
    each maximal run of good windows; n_tokens is the number of the item's
    distinct terms in it and item_start null. Words are
    compared in lower case, without punctuation. Rows with a null id, null or
    empty texts and items match nothing, and an empty table gives no row; texts
    of any length are indexed to their end. Every exact run is given, also
    where several lie in one document; repeated rows give one result; other
    columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item"), F.col("text").cast("string").alias("text")).filter("item IS NOT NULL AND text IS NOT NULL").distinct()
    # one block of items at a time reaches the driver and the executors, however many there are
    number = items.count()
    blocks = max(1, -(-number // ITEMS_PER_PASS))
    longest = items.select("text").mapInArrow(_sizes, "n long").agg(F.max("n")).first()[0] or 1
    stored = cut(index(docs, math.ceil(SLACK * longest) + PHRASE + 2, id_col, text_col), "index")
    found = None
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        now = _search(spark, stored, [(r["item"], t) for r in part if len(t := terms_of(r["text"])) >= shortest], every)
        found = now if found is None else found.unionByName(now)
    return found.distinct()


def _search(spark: SparkSession, stored: DataFrame, part: list[tuple[int, list[int]]], every: bool) -> DataFrame:
    wanted = np.array(sorted({t for _, terms in part for t in terms}), np.uint64)
    number = {t: k for k, t in enumerate(wanted.tolist())}
    frequency = term_counts(stored, wanted)
    # of at most ITEMS_PER_PASS items
    shared = spark.sparkContext.broadcast((wanted, Items([Item(i, terms, number, frequency) for i, terms in part])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, items = shared.value
        names = ["doc_id", "item_id", "match", "doc_start", "item_start", "n_tokens"]
        for batch in batches:
            for k in range(batch.num_rows):
                segment = Segment(*(batch.column(c)[k].as_py() for c in range(5)))
                rows = segment.find(wanted)
                out = []
                for item, phrases in items.phrases(rows):
                    for doc, start, item_start, n in exact_matches(segment, rows, item, phrases):
                        out.append((int(segment.ids[doc]), item.id, "exact", start, item_start, n))
                for item in items.windows(rows):
                    for doc, start, n in proximity_matches(segment, rows, item, every):
                        out.append((int(segment.ids[doc]), item.id, "proximity", start, None, n))
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return stored.drop("segment").mapInArrow(tidy(run), "doc_id long, item_id long, match string, doc_start long, item_start long, n_tokens long")


def contaminated(docs: DataFrame, benchmark: DataFrame, chance_run: int = CHANCE_RUN) -> DataFrame:
    """_gm_id of the documents with a proximity match, or an exact run of more than chance_run tokens or of at least SHARE of an item of more than CHANCE_ITEM tokens."""
    found = matches(docs, benchmark, shortest=CHANCE_ITEM + 1)
    sizes = benchmark.groupBy(F.col("item_id").cast("long").alias("_gm_item")).agg(F.max(F.size(F.expr(r"regexp_extract_all(text, '[\\p{L}\\p{N}_]+', 0)"))).alias("_gm_size"))
    return found.join(sizes, found["item_id"] == sizes["_gm_item"]).filter((F.col("match") == "proximity") | (F.col("n_tokens") > chance_run) | (F.col("n_tokens") >= SHARE * F.col("_gm_size"))).select(F.col("doc_id").alias("_gm_id")).distinct()


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones; rows with a null id stay."""
    return without(docs, cut(contaminated(docs, benchmark), "contaminated"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), every=True)
