"""URL filter: words of host names, then naive Bayes.

Host labels are split into words by unigram Viterbi, with word counts from all
documents; a multinomial naive Bayes model, trained on labelled URLs, scores
the words of host and path.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grovemap.llm.common import cut, least_hashed, table

#: Letters that a label of a host name may have (RFC 1035). A longer run of letters is no host name and stays one word.
LABEL_LETTERS = 63
#: Candidate words up to which their table is sent to the words of the documents; beyond, the words are counted first and both sides shuffled.
SMALL_TABLE = 200_000
#: Log odds above which a URL is blocked, and the prior probability of a bad one.
CUTOFF = 0.0
PRIOR_BAD = 0.1
#: Most labelled URLs that a table of them is to give.
MAX_LABELLED = 20_000
#: Share of the corpus that a word of the labelled URLs counts for, at least.
SEED_SHARE = 1e-6
BAD = [
    "casino-win.test/play/bonus", "freebets.test/join", "free-casino.test/slots", "bestbets.test/odds/free", "pokerwin.test/bonus", "online-poker.test/casino", "cheappills.test/buy", "cheap-pills.test/order/now", "buypills.test/cheap/viagra", "pharmacy-discount.test/pills", "adstrack.test/click", "ads-click.test/track/redirect",
    "trackads.test/banner", "popup-ads.test/click", "winmoney.test/free/cash", "fast-loans.test/cash", "payday-loans.test/money", "hotxxx.test/porn", "adult-porn.test/xxx/free", "free-download-crack.test/keygen", "replica-watches.test/cheap/buy", "lottery-win.test/prize", "prize-winner.test/claim/free", "spam-links.test/seo/buy",
]
GOOD = [
    "news-daily.test/world/article", "blog-garden.test/post/recipes", "wiki-reference.test/article/history", "docs-library.test/guide/install", "school-library.test/courses", "universitypress.test/books/history", "cityhall.test/services/library", "weather-report.test/today", "opensource-code.test/docs/api", "musicschool.test/lessons",
    "healthguide.test/article/sleep", "travel-notes.test/post/rome", "sciencenews.test/article/space", "books-review.test/review/novel", "gardenblog.test/post/roses", "localnews.test/sports/results", "recipe-book.test/soup", "museum-art.test/exhibition", "forum-help.test/question/python", "shop-books.test/catalog/history", "railway-map.test/stations", "museumguide.test/rooms/art",
    "mathnotes.test/lecture/algebra", "bird-watching.test/guide",
]


def host_of(url: Column) -> Column:
    """Host in lower case, without user, port and leading `www.`; empty where there is none, null for null."""
    u = F.regexp_replace(F.trim(url), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    h = F.regexp_replace(F.regexp_extract(u, "^[^/?#]*", 0), "^.*@", "")
    return F.regexp_replace(F.regexp_replace(F.lower(h), ":[0-9]*$", ""), "^www[.]", "")


def path_words(url: Column) -> Column:
    """Runs of letters after the host, in lower case; runs of digits are `<num>`."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "^[^/?#]*", "")
    found = F.regexp_extract_all(F.lower(rest), F.lit(r"[\p{L}]+|[0-9]+"), F.lit(0))
    return F.transform(found, lambda w: F.when(w.rlike("^[0-9]"), "<num>").otherwise(w))


def label_parts(host: Column) -> Column:
    """Runs of letters of the host's labels, its last one (the top-level domain) left out."""
    return F.regexp_extract_all(F.regexp_replace(host, "[.][^.]*$", ""), F.lit(r"\p{L}+"), F.lit(0))


def plain_words(urls: Iterable[str]) -> list[list[str]]:
    """Runs of letters of each URL, in lower case, without its top-level domain."""
    out = []
    for u in urls:
        host, slash, path = re.sub("^[A-Za-z][A-Za-z0-9+.-]*://", "", u).lower().partition("/")
        out.append(re.findall(r"[^\W\d_]+", re.sub("[.][^.]*$", "", host) + slash + path))
    return out


def seed_words() -> list[str]:
    """Words of the labelled URLs, which hosts may run together."""
    known = "casino win free bets best poker online cheap pills buy pharmacy discount ads track click popup money fast loans payday hot xxx adult porn download crack replica watches lottery prize winner spam links seo news daily blog garden wiki reference docs library school university press city hall weather report open source code music health guide travel notes science books review local recipe book museum art forum help shop railway map math bird watching"
    return sorted(set(known.split()))


def viterbi(label: str, count: dict[str, float], total: float) -> list[str]:
    """The split of label with the highest product of word probabilities. A word never seen has probability 10**-length / total; of equal splits the one with the longer last words counts."""
    best = [0.0] + [-math.inf] * len(label)
    back = [0] * (len(label) + 1)
    log_total = math.log(total)
    for end in range(1, len(label) + 1):
        for start in range(end):
            n = count.get(label[start:end], 0)
            score = best[start] + (math.log(n) if n > 0 else -(end - start) * math.log(10)) - log_total
            if score > best[end]:
                best[end], back[end] = score, start
    words, end = [], len(label)
    while end:
        words.append(label[back[end] : end])
        end = back[end]
    return words[::-1]


def train(bad: Sequence[str] = BAD, good: Sequence[str] = GOOD) -> dict[str, float]:
    """Log odds of each word of the labelled URLs, by multinomial naive Bayes with add-one smoothing; words of neither class have none."""
    seeds = dict.fromkeys(seed_words(), 1.0)
    counts = [Counter(w for part in plain_words(urls) for chunk in part for w in viterbi(chunk, seeds, 1000.0)) for urls in (bad, good)]
    vocabulary = sorted(set(counts[0]) | set(counts[1]))
    sums = [sum(c.values()) + len(vocabulary) + 1 for c in counts]
    return {w: math.log((counts[0][w] + 1) / sums[0]) - math.log((counts[1][w] + 1) / sums[1]) for w in vocabulary}


def labelled_urls(urls: DataFrame, limit: int = MAX_LABELLED) -> tuple[list[str], list[str]]:
    """Bad and good URLs of a table (url, bad), at most `limit` in all, in the order of a hash; one with both labels counts as good."""
    one = urls.filter("url IS NOT NULL AND bad IS NOT NULL").groupBy(F.col("url").cast("string").alias("url")).agg(F.min(F.col("bad").cast("boolean")).alias("bad"))
    rows = sorted(map(tuple, least_hashed(one, "url", limit).collect()))
    return [u for u, b in rows if b], [u for u, b in rows if not b]


def word_counts(docs: DataFrame, candidates: DataFrame) -> tuple[DataFrame, int]:
    """(sub, n) of each candidate found among the words of all documents, and the number of all words."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit(r"\p{L}+"), F.lit(0))).alias("sub"))
    small = candidates.count() <= SMALL_TABLE
    if small:
        marked = words.join(F.broadcast(candidates.withColumn("hit", F.lit(True))), "sub", "left")
        counts = cut(marked.groupBy(F.when(F.col("hit"), F.col("sub")).alias("sub")).agg(F.count(F.lit(1)).alias("n")), "words")
        return counts.filter("sub IS NOT NULL"), counts.agg(F.sum("n")).first()[0] or 0
    counts = cut(words.groupBy("sub").agg(F.count(F.lit(1)).alias("n")), "words")
    return counts.join(candidates, "sub"), counts.agg(F.sum("n")).first()[0] or 0


def segmented(parts: DataFrame, docs: DataFrame) -> DataFrame:
    """(part, words) of each distinct part."""
    subs = F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("part")), lambda i: F.transform(F.sequence(F.lit(1), F.length("part") - i + 1), lambda n: F.substring(F.col("part"), i, n))))))
    names, rest = parts.filter(F.length("part") <= LABEL_LETTERS), parts.filter(F.length("part") > LABEL_LETTERS)
    pairs = names.select("part", subs.alias("sub"))
    counts, total = word_counts(docs, pairs.select("sub").distinct())
    seeds = {w: max(1.0, SEED_SHARE * total) for w in seed_words()}
    found = pairs.join(counts, "sub").groupBy("part").agg(F.collect_list(F.struct("sub", "n")).alias("known"))

    @F.pandas_udf("array<string>")
    def split(labels: pd.Series, known: pd.Series) -> pd.Series:
        out = []
        for label, pairs in zip(labels, known):
            count = {p["sub"]: float(p["n"]) for p in pairs} if pairs is not None else {}
            for w, n in seeds.items():
                count[w] = max(count.get(w, 0.0), n)
            out.append(viterbi(label, count, max(float(total), 1000.0)))
        return pd.Series(out)

    return names.join(found, "part", "left").select("part", split("part", "known").alias("words")).unionByName(rest.select("part", F.array("part").alias("words")))


def score_urls(pages: DataFrame, docs: DataFrame, cutoff: float = CUTOFF, odds: dict[str, float] | None = None) -> DataFrame:
    """(page_id, host_words, log_odds, blocked) of each page.

    host_words: the words of the host's labels without the top-level domain,
    joined by spaces. log_odds: the prior's plus that of each host and path
    word, a word as often as it occurs. A null or empty URL has no word, hence
    the prior's odds. Repeated pages give repeated rows; other columns are
    ignored; without documents the labelled URLs' words alone are known, and an
    empty table of pages gives no row. Hosts are segmented once each, however
    many pages they have; URLs are read to their end, and a run of more than
    LABEL_LETTERS letters in the place of a host name stays one word. odds: of
    words, as train() gives them for labelled URLs, by default the module's.
    """
    odds = train() if odds is None else odds
    urls = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("_gm_url"))
    urls = urls.select("page_id", host_of(F.col("_gm_url")).alias("host"), path_words(F.col("_gm_url")).alias("path"))
    hosts = urls.select("host").distinct().select("host", F.posexplode(label_parts(F.col("host"))).alias("at", "part"))
    hosts = cut(hosts, "hosts")
    words = segmented(hosts.select("part").distinct(), docs)
    per_host = hosts.join(words, "part").groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("host_words"))
    table_of = F.create_map(*[F.lit(x) for w, v in odds.items() for x in (w, v)])
    per_word = lambda ws: F.aggregate(F.transform(ws, lambda w: F.coalesce(F.element_at(table_of, w), F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)
    none = F.array().cast("array<string>")
    joined = urls.join(per_host, "host", "left").withColumn("host_words", F.coalesce("host_words", none))
    total = F.lit(math.log(PRIOR_BAD / (1 - PRIOR_BAD))) + per_word(F.col("host_words")) + per_word(F.coalesce("path", none))
    return joined.select("page_id", F.array_join("host_words", " ").alias("host_words"), F.round(total, 6).alias("log_odds")).withColumn("blocked", F.col("log_odds") > cutoff)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
