"""Full-text index: positional postings and BM25 top-k, as joins and aggregations.

Postings are a table (term, id, tf, positions) clustered by term, so a query
reads its own terms' rows; documents' lengths are a second, narrow table.
Nothing here depends on the number of documents but the shuffles themselves.

Impacts are the same postings with their lengths and a level, the bound of what
a posting can add to a score, sorted by term and falling level. Counts of
postings by term and level, a few hundred rows a term, say beforehand which
levels can matter to a query's best documents; the others are not read, for
Parquet's statistics of term and level leave out their pages.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

K1, B = 1.2, 0.75
FIELDS = ("title", "summary", "preview_text", "transcript_text")
#: Levels into which the impact of one posting, below K1 + 1, is divided.
LEVELS = 220
#: What rounding of scores may hide.
ROUNDED = 1e-6
#: Positions of one field end well before those of the next, so phrases never cross.
FIELD_GAP = 10_000_000


def postings(rows: DataFrame, fields=FIELDS, key: str = "id") -> DataFrame:
    """(term, id, tf, positions) over the fields of rows."""
    parts = [_placed(f, k) for k, f in enumerate(fields)]
    one = rows.select(F.col(key).alias("id"), F.explode(F.concat(*parts)).alias("w"))
    return one.groupBy(F.col("w.term").alias("term"), "id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("w.at")).alias("positions"))


def _placed(field: str, k: int):
    words = text.tokens(F.coalesce(F.col(field), F.lit("")))
    return F.transform(words, lambda w, i: F.struct(w.alias("term"), (i.cast("long") + F.lit(k * FIELD_GAP)).alias("at")))


def lengths(rows: DataFrame, fields=FIELDS, key: str = "id") -> DataFrame:
    sizes = [F.size(text.tokens(F.coalesce(F.col(f), F.lit("")))) for f in fields]
    return rows.select(F.col(key).alias("id"), functools.reduce(lambda a, b: a + b, sizes).cast("long").alias("len"))


def _matches(index: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """(q, id, tf): in which documents and how often each phrase of terms is."""
    found = []
    times = [(p[0], k) for k, p in enumerate(phrases) if len(p) == 1]
    if times:  # all single terms in one pass; a word that repeats counts again
        words = sorted({w for w, _ in times})
        numbers = functools.reduce(lambda c, w: c.when(F.col("term") == w, F.array(*[F.lit(k) for v, k in times if v == w])), words, F)
        found.append(index.where(F.col("term").isin(words)).select(F.explode(numbers).alias("q"), "id", "tf"))
    for k, parts in enumerate(phrases):
        if len(parts) == 1:
            continue
        first = index.where(F.col("term") == parts[0]).select("id", "positions")
        for n, part in enumerate(parts[1:], 1):
            other = index.where(F.col("term") == part).select("id", F.col("positions").alias("then"))
            first = first.join(other, "id").select("id", F.array_intersect("positions", _back("then", n)).alias("positions"))
        found.append(first.select(F.lit(k).alias("q"), "id", F.size("positions").cast("long").alias("tf")).where("tf > 0"))
    return functools.reduce(DataFrame.unionByName, found)


def _back(column: str, k: int):
    return F.transform(column, lambda p: p - F.lit(k))


def bm25(index: DataFrame, docs: DataFrame, query: str) -> DataFrame:
    """(id, bm25) of the documents with any of the query's words; higher is better."""
    wanted = text.query_terms(query)
    if not wanted:
        return docs.select("id", F.lit(0.0).alias("bm25")).limit(0)
    hits = _matches(index, wanted)
    df = hits.groupBy("q").agg(F.count("*").alias("df"))
    stats = docs.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = df.join(F.broadcast(stats)).select(  # one row of totals
        "q", F.when(idf <= 0, 1e-6).otherwise(idf).alias("idf"), "avg_len")
    scored = hits.join(F.broadcast(weights), "q").join(docs, "id")
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return scored.groupBy("id").agg(F.sum(F.col("idf") * tf).alias("bm25"))


def scanned(rows: DataFrame, query: str, fields=FIELDS, key: str = "id") -> DataFrame:
    """(id, bm25) as bm25 gives it, of rows without an index: each text is cut into words once, and
    only counts of the query's phrases leave it. The counts are dealt by id, so that totals and
    scores read the same exchange."""
    wanted = text.query_terms(query)
    if not wanted:
        return rows.select(F.col(key).alias("id"), F.lit(0.0).alias("bm25")).limit(0)
    gap = F.array(F.lit(""))  # no phrase crosses fields
    words = functools.reduce(lambda a, b: F.concat(a, gap, b), [text.tokens(F.coalesce(F.col(f), F.lit(""))) for f in fields])
    # unfolded from an array of one, so that the optimizer does not copy the cutting into every count
    one = rows.select(F.col(key).alias("id"), F.inline(F.array(F.struct(words.alias("words")))))
    counts = one.select("id", (F.size("words") - (len(fields) - 1)).cast("long").alias("len"), *[_times(F.col("words"), p).alias(f"tf{k}") for k, p in enumerate(wanted)]).repartition("id")
    stats = counts.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(wanted))])
    some = counts.where(functools.reduce(lambda a, b: a | b, [F.col(f"tf{k}") > 0 for k in range(len(wanted))])).join(F.broadcast(stats))  # one row of totals
    score = F.lit(0.0)
    for k in range(len(wanted)):
        idf = F.log((F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5))
        tf = F.col(f"tf{k}") * (K1 + 1) / (F.col(f"tf{k}") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
        score = score + F.when(F.col(f"tf{k}") > 0, F.when(idf <= 0, 1e-6).otherwise(idf) * tf).otherwise(0.0)
    return some.select("id", score.alias("bm25"))


def _times(words: Column, phrase: list[str]) -> Column:
    """How often the words hold the phrase."""
    if len(phrase) == 1:
        return F.size(F.filter(words, lambda w: w == phrase[0])).cast("long")
    last = F.size(words) - len(phrase)
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    here = lambda i: functools.reduce(lambda a, b: a & b, [F.get(words, i + k) == p for k, p in enumerate(phrase)])
    return F.size(F.filter(starts, here)).cast("long")


def top(index: DataFrame, docs: DataFrame, query: str, k: int) -> DataFrame:
    """The k best documents of a query: (id, bm25), ties to the smaller id."""
    return _best(bm25(index, docs, query), k)


def _share(tf, length, avg):
    """What a posting adds to a score besides its term's weight: of columns or numbers."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg))


def impacts(index: DataFrame, docs: DataFrame, avg: float) -> DataFrame:
    """(term, level, id, tf, len) of all postings; the share of a posting, at the given average length, is
    at most level * (K1 + 1) / LEVELS and more than that of the level below."""
    level = F.ceil(_share(F.col("tf"), F.col("len"), F.lit(float(avg or 1))) * LEVELS / (K1 + 1) - 1e-9)
    return index.select("term", "id", "tf").join(docs, "id").select("term", level.cast("int").alias("level"), "id", "tf", "len")


def headers(rows: DataFrame) -> DataFrame:
    """(term, level, n): how many impacts there are."""
    return rows.groupBy("term", "level").agg(F.count("*").alias("n"))


@dataclass
class Part:
    """Impacts and headers of some documents, all different from those of other parts: their number, the sum of
    their lengths, and the average length at which levels were computed."""

    impacts: DataFrame
    headers: DataFrame
    docs: int
    words: int
    avg: float


@dataclass
class Pruned:
    """The best documents, and of all postings of the query's terms those that were read."""

    best: DataFrame
    read: int
    postings: int


def top_pruned(parts: list[Part], query: str, k: int) -> Pruned | None:
    """As top, by impacts: levels that cannot reach the k best are not read. None if the query has a phrase.

    A bound on the k-th best score comes from the counts alone: the k postings of a
    term with the highest levels are of k documents that each score as much at least
    as the level below theirs stands for. What the best levels hold, read
    next, gives a better one: partial scores are bounds from below too. A level of a term can matter if
    it, with the highest levels of all other terms, reaches that bound; a document
    that reaches it has no posting in other levels, so its score is exact.
    """
    wanted = text.query_terms(query)
    if any(len(p) > 1 for p in wanted):
        return None
    times = {w: sum(p[0] == w for p in wanted) for p in wanted for w in p}
    docs, words = sum(p.docs for p in parts), sum(p.words for p in parts)
    if not times or not docs or not words:
        return Pruned(parts[0].impacts.select("id", F.lit(0.0).alias("bm25")).limit(0) if parts else None, 0, 0)
    avg = words / docs
    headed = [p.headers.where(F.col("term").isin(*times)).select(F.lit(j).alias("part"), "term", "level", "n") for j, p in enumerate(parts)]
    found = [tuple(r) for r in functools.reduce(DataFrame.unionByName, headed).collect()]  # LEVELS rows a term and part at most
    df = {w: sum(n for _, t, _, n in found if t == w) for w in times}
    idf = {w: max(math.log((docs - df[w] + 0.5) / (df[w] + 0.5)), 0) or 1e-6 for w in times}
    # a longer average length now raises shares by the ratio at most, a shorter one lowers them so
    high = lambda j, w, level: times[w] * idf[w] * min(level / LEVELS * max(1.0, avg / (parts[j].avg or 1)), 1.0) * (K1 + 1)
    low = lambda j, w, level: times[w] * idf[w] * (level - 1) / LEVELS * min(1.0, avg / (parts[j].avg or 1)) * (K1 + 1)
    best = {w: max((high(j, t, level) for j, t, level, _ in found if t == w), default=0.0) for w in times}

    def kth(rows: list[tuple[float, int]]) -> float:
        """The score that the k-th best has at least, of (score, documents)."""
        seen = 0
        for score, n in sorted(rows, reverse=True):
            seen += n
            if seen >= k:
                return score
        return 0.0

    bound = max((kth([(low(j, t, level), n) for j, t, level, n in found if t == w]) for w in times), default=0.0)

    def levels(bound: float) -> dict[tuple[int, str], int]:
        """The least level of each part and term that can matter."""
        out: dict[tuple[int, str], int] = {}
        for j, t, level, _ in found:
            if high(j, t, level) + sum(b for w, b in best.items() if w != t) >= bound - ROUNDED:
                out[j, t] = min(level, out.get((j, t), level))
        return out

    def scored(least: dict[tuple[int, str], int]) -> DataFrame | None:
        some = []
        for j, p in enumerate(parts):
            tests = [(F.col("term") == w) & (F.col("level") >= level) for (i, w), level in least.items() if i == j]
            if tests:
                some.append(p.impacts.where(functools.reduce(lambda a, b: a | b, tests)).select("term", "id", "tf", "len"))
        if not some:
            return None
        weight = functools.reduce(lambda c, w: c.when(F.col("term") == w, times[w] * idf[w]), times, F)
        return functools.reduce(DataFrame.unionByName, some).groupBy("id").agg(F.sum(weight * _share(F.col("tf"), F.col("len"), F.lit(avg))).alias("bm25"))

    size = lambda least: sum(n for j, t, level, n in found if level >= least.get((j, t), LEVELS + 1))
    least = levels(bound)
    if size(least) > 4 * k and len(times) > 1:  # the best k of each term's levels, read together
        first: dict[tuple[int, str], int] = {}
        for w in times:
            edge = kth([(high(j, t, level), n) for j, t, level, n in found if t == w])
            first |= {key: level for key, level in ((key, min(x for j, t, x, _ in found if (j, t) == key and high(j, t, x) >= edge)) for key in {(j, t) for j, t, x, _ in found if t == w and high(j, t, x) >= edge})}
        if size(first) < size(least):
            partial = [r.bm25 for r in scored(first).orderBy(F.desc("bm25")).limit(k).collect()]
            bound = max(bound, partial[-1] if len(partial) == k else 0.0)
            least = levels(bound)
    rows = scored(least)
    return Pruned(parts[0].impacts.select("id", F.lit(0.0).alias("bm25")).limit(0) if rows is None else _best(rows, k), size(least), sum(n for *_, n in found))


def top_scanned(rows: DataFrame, query: str, k: int, fields=FIELDS, key: str = "id") -> DataFrame:
    """As top, of rows without an index."""
    return _best(scanned(rows, query, fields, key), k)


def _best(scores: DataFrame, k: int) -> DataFrame:
    return scores.withColumn("bm25", F.round("bm25", 6)).orderBy(F.desc("bm25"), "id").limit(k)
