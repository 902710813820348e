"""Listing, ranked search, prefix lookup and counts over sessions and transcripts."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.rows import once
from ..schema import Filters
from . import fts

#: Where a match may lie, in order of preference at equal scores, and what the whole query scores there.
SOURCES = (("title", "title", 600), ("summary", "summary", 450), ("cwd", "cwd", 350), ("repo", "repo_root", 350), ("preview", "preview_text", 250), ("transcript", "transcript_text", 100))
FUZZY_SOURCES = ("title", "cwd", "repo", "preview")
TOKEN_SCORE, ALL_TOKENS_SCORE, REPO_SCORE = 40, 150, 200
#: Candidates of the index for each wanted result.
CANDIDATES = 5


def matching(f: Filters) -> Column:
    """The rows that the filters let through."""
    keep = [F.lit(True)]
    if f.provider is not None:
        keep.append(F.col("provider") == f.provider)
    if f.path_prefix is not None:
        keep.append(text.starts_like(F.col("cwd"), f.path_prefix) | text.starts_like(F.col("repo_root"), f.path_prefix))
    if f.since is not None:
        keep.append(F.coalesce("updated_at", "created_at") >= text.as_timestamp(f.since))
    if f.warnings_only:
        keep.append(F.col("parse_warning").isNotNull() & (F.col("parse_warning") != ""))
    return functools.reduce(lambda a, b: a & b, keep)


def list_recent(sessions: DataFrame, f: Filters) -> DataFrame:
    """The last updated sessions, those without a time last."""
    return sessions.where(matching(f)).orderBy(F.desc_nulls_last("updated_at"), "id").limit(f.limit)


def with_transcripts(sessions: DataFrame, transcripts: DataFrame | None) -> DataFrame:
    """sessions with their transcript_text, unless they have it."""
    if "transcript_text" in sessions.columns:
        return sessions
    own = transcripts.select(F.col("session_id").alias("id"), "transcript_text")
    return sessions.join(own, "id", "left").withColumn("transcript_text", F.coalesce("transcript_text", F.lit("")))


def recency(updated: Column, as_of: Column) -> Column:
    """Two points for each of the last 90 days that a session is younger than."""
    days = F.least(F.greatest(text.days_since(updated, as_of), F.lit(0)), F.lit(90))
    return F.when(updated.isNull(), 0).otherwise((90 - days) * 2).cast("long")


def ranked(rows: DataFrame, query: str, as_of, current_repo: str | None = None, fuzzy: Callable[[Column, str], Column] | None = None) -> DataFrame:
    """rows (sessions with transcript_text) plus score, match_source and match_value.

    fuzzy is a function column, query -> score, 0 where nothing matches; without
    it the score is exact substring matching, recency and repository alone.
    """
    low = query.translate(str.maketrans(text.UPPER, text.LOWER))
    words, names = low.split(), [n for n, _, _ in SOURCES]
    out = once(rows, **{f"_v_{n}": F.coalesce(F.col(c), F.lit("")) for n, c, _ in SOURCES})
    out = once(out, **{f"_l_{n}": text.ascii_lower(F.col(f"_v_{n}")) for n in names})
    near = {n: F.col(f"_f_{n}") for n in FUZZY_SOURCES} if fuzzy else {}
    out = out.select("*", *(fuzzy(F.col(f"_v_{n}"), query).alias(f"_f_{n}") for n in near))
    hits = {n: functools.reduce(lambda a, b: a + b, [F.contains(f"_l_{n}", F.lit(w)).cast("int") for w in words], F.lit(0)) for n in names}
    out = once(out, **{f"_h_{n}": hits[n] for n in names}, **{f"_w_{n}": F.when(F.contains(f"_l_{n}", F.lit(low)), whole).otherwise(0) for n, _, whole in SOURCES})
    each = {n: F.col(f"_w_{n}") + F.col(f"_h_{n}") * TOKEN_SCORE + near.get(n, F.lit(0)) for n in names}
    best, source, value = F.greatest(*each.values()), F.lit(names[0]), F.col(f"_v_{names[0]}")
    for n in reversed(names):
        source, value = F.when(each[n] == best, n).otherwise(source), F.when(each[n] == best, F.col(f"_v_{n}")).otherwise(value)
    score = functools.reduce(lambda a, b: a + b, each.values()) + recency(F.col("updated_at"), text.as_timestamp(as_of))
    if len(words) > 1:
        score = score + F.when(F.greatest(*(F.col(f"_h_{n}") for n in names)) == len(words), ALL_TOKENS_SCORE).otherwise(0)
    if current_repo is not None:
        score = score + F.when(F.coalesce(F.col("repo_root") == current_repo, F.lit(False)), REPO_SCORE).otherwise(0)
    return out.select(*rows.columns, source.alias("match_source"), value.alias("match_value"), score.cast("long").alias("score"))


def search(
    sessions: DataFrame, transcripts: DataFrame | None, query: str, f: Filters, as_of, current_repo: str | None = None, index: tuple[DataFrame, DataFrame] | None = None,
    fuzzy: Callable[[Column, str], Column] | None = None, snippet: Callable[[Column, str], Column] | None = None, prefilter: bool = False, best: DataFrame | None = None,
) -> DataFrame:
    """The best sessions for a query, best first.

    index (postings, lengths) names the candidates: the best CANDIDATES * limit of
    all sessions, or of those that pass the filters with prefilter. If it has
    none, all filtered sessions are ranked, so that recent ones still show; if
    filters remove all candidates, nothing is found. best: the best of all sessions, where they are known already.
    """
    pool = sessions.where(matching(f))
    if index is not None:
        postings, lengths = index
        if prefilter:
            postings, lengths = (d.join(pool.select("id"), "id", "left_semi") for d in index)
        first = fts.top(postings, lengths, query, f.limit * CANDIDATES) if best is None or prefilter else best
        if ids := [r["id"] for r in first.select("id").collect()]:  # a bounded few, looked up in both tables
            pool = pool.where(F.col("id").isin(ids))
            transcripts = transcripts if transcripts is None else transcripts.where(F.col("session_id").isin(ids))
    hits = ranked(with_transcripts(pool, transcripts), query, as_of, current_repo, fuzzy).where("score > 0")
    top = hits.orderBy(F.desc("score"), F.desc_nulls_last("updated_at"), "id").limit(f.limit)
    return top.withColumn("match_snippet", snippet(F.col("match_value"), query)) if snippet else top


def resolve(sessions: DataFrame, value: str) -> DataFrame:
    """Sessions whose id or provider id is or begins with value; an exact one has no priority."""
    exact = (F.col("id") == value) | (F.col("provider_session_id") == value)
    return sessions.where(exact | text.starts_like(F.col("id"), value) | text.starts_like(F.col("provider_session_id"), value))


def only(found: list, value: str):
    """The one that was found for value."""
    if not found:
        raise LookupError(f"no session matches '{value}'")
    if len(found) > 1:
        raise LookupError(f"session prefix '{value}' is ambiguous")
    return found[0]


def resolve_one(sessions: DataFrame, value: str):
    return only(resolve(sessions, value).limit(2).collect(), value)


def counts_by_provider(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("provider").agg(F.count("*").alias("n"))


def health(known: DataFrame, found: DataFrame, sessions: DataFrame) -> DataFrame:
    """known (provider and what is known of it) with discovered_files of found files and sessions that are indexed, 0 where there are none."""
    files = found.groupBy("provider").agg(F.count("*").alias("discovered_files"))
    counts = counts_by_provider(sessions).withColumnRenamed("n", "sessions")
    return known.join(files, "provider", "left").join(counts, "provider", "left").fillna(0, ["discovered_files", "sessions"])


def parse_warnings(sessions: DataFrame) -> DataFrame:
    return sessions.where(matching(Filters(warnings_only=True))).agg(F.count("*").alias("n"))
