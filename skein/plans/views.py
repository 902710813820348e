"""The driver's tables seen as sessions, transcripts and messages; the same view as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import ingest
from ..schema import PROVIDERS

AS_OF = "2024-02-01 00:00:00"


def provider_of(conv_id: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, PROVIDERS)), (conv_id % 4 + 1).cast("int"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is a session of the provider its id picks."""
    rows = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    return rows.select("conv_id", F.concat(provider_of(F.col("conv_id")), F.lit(":"), F.col("conv_id")).alias("session_id"), F.col("turn").alias("seq"), "role", "text")


def lines(rows: DataFrame) -> DataFrame:
    """Messages as the decoded lines that ingestion folds, all of them kept."""
    null = lambda kind: F.lit(None).cast(kind)
    return rows.select(
        provider_of(F.col("conv_id")).alias("provider"), F.col("session_id").alias("source_path"), F.lit(0).cast("long").alias("mtime_ns"), F.lit(0).cast("long").alias("size_bytes"), F.col("seq").alias("place"), null("string").alias("error"),
        "session_id", null("string").alias("cwd"), null("string").alias("ts"), null("string").alias("start"), "role", "text", null("boolean").alias("is_meta"), null("string").alias("last_prompt"),
        null("timestamp").alias("at"), F.lit(True).alias("kept"), null("timestamp").alias("mtime"),
    )


def folds(rows: DataFrame) -> DataFrame:
    """First and last thing a user said, number of messages, transcript: ingestion's folds."""
    out = ingest.folded(lines(rows))
    return out.select(F.substring_index("source_path", ":", -1).cast("long").alias("conv_id"), F.col("source_path").alias("session_id"), "first_user", "last_user", "message_count", "transcript_text")


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, provider) of the same sessions, without their texts."""
    ids = messages(spark, sf_dir).select(F.col("session_id").alias("id"), provider_of(F.col("conv_id")).alias("provider"))
    return ids.distinct()


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All session columns that the queries use, transcript_text among them."""
    f = folds(messages(spark, sf_dir))
    shift = F.make_dt_interval((F.col("conv_id") % 100).cast("int"))
    times = table(spark, sf_dir, "events").where("user_id % 2 = 0").groupBy((F.col("user_id") / 2).cast("long").alias("conv_id")).agg(F.min("ts").cast("timestamp").alias("lo"), F.max("ts").cast("timestamp").alias("hi"))
    where = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), F.concat(F.lit("/repo/"), F.col("source")).alias("cwd"))
    rows = f.join(times, "conv_id", "left").join(where, "conv_id", "left")
    said = F.coalesce("last_user", "first_user")
    return rows.select(
        F.col("session_id").alias("id"), F.substring_index("session_id", ":", 1).alias("provider"), F.col("conv_id").cast("string").alias("provider_session_id"), "conv_id",
        text.truncated(said, 100).alias("title"), text.truncated(F.col("first_user"), 180).alias("summary"), "cwd", F.when(F.col("conv_id") % 2 == 0, F.col("cwd")).alias("repo_root"),
        (F.col("lo") - shift).alias("created_at"), (F.col("hi") - shift).alias("updated_at"), F.coalesce(text.preview(said), F.lit("(no preview available)")).alias("preview_text"),
        "message_count", F.when(F.col("hi").isNull(), "no time").when(F.col("conv_id") % 7 == 0, "").alias("parse_warning"), "transcript_text",
    )


def _bytes_cut(c: str, n: int) -> str:
    w = f"trim(regexp_replace({c}, '[\\s\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"
    cut = f"left({w}, cast(list_max(list_filter(range(0, {n - 2}), lambda i: strlen(left({w}, cast(i as int))) <= {n - 3})) as int))"
    return f"case when strlen({w}) <= {n} then {w} else {cut} || '...' end"


ASCII = f"translate({{}}, '{text.UPPER}', '{text.LOWER}')"
_T = "trim(regexp_replace(text, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'))"
SUBSTANTIVE = f"({_T} <> '' and not contains({_T}, '<local-command-') and not contains({_T}, '<command-name>/') and {ASCII.format(_T)} not in ({', '.join(repr(p) if chr(39) not in p else chr(39) + p.replace(chr(39), chr(39) * 2) + chr(39) for p in text.EMPTY_PHRASES)}))"

MESSAGES_SQL = """messages as (select conv_id, (['claude','codex','cursor','antigravity'])[conv_id % 4 + 1] || ':' || conv_id as session_id, turn as seq, role, text
  from conversations where role in ('user', 'assistant'))"""

FOLDS_SQL = f"""{MESSAGES_SQL},
folds as (select conv_id, session_id,
  arg_min(text, seq) filter (role = 'user' and (conv_id % 4 = 1 or {SUBSTANTIVE})) as first_user,
  arg_max(text, seq) filter (role = 'user' and (conv_id % 4 = 1 or {SUBSTANTIVE})) as last_user,
  count(*) as message_count,
  string_agg('[unknown-time] ' || role || chr(10) || text, chr(10) || chr(10) order by seq) as transcript_text
  from messages group by conv_id, session_id)"""

SESSIONS_SQL = f"""{FOLDS_SQL},
times as (select user_id // 2 as conv_id, min(ts) as lo, max(ts) as hi from events where user_id % 2 = 0 group by 1),
joined as (select f.*, coalesce(last_user, first_user) as said, lo, hi, '/repo/' || d.source as cwd
  from folds f left join times using (conv_id) left join documents d on d.doc_id = f.conv_id),
sessions as (select session_id as id, split_part(session_id, ':', 1) as provider, cast(conv_id as varchar) as provider_session_id, conv_id,
  {_bytes_cut('said', 100)} as title, {_bytes_cut('first_user', 180)} as summary, cwd, case when conv_id % 2 = 0 then cwd end as repo_root,
  lo - to_days(cast(conv_id % 100 as int)) as created_at, hi - to_days(cast(conv_id % 100 as int)) as updated_at,
  coalesce(case when trim(regexp_replace(said, '[\\s\\p{{Z}}]+', ' ', 'g')) = '' then '(no preview available)' else {_bytes_cut('said', 140)} end, '(no preview available)') as preview_text,
  message_count, case when hi is null then 'no time' when conv_id % 7 = 0 then '' end as parse_warning, transcript_text from joined)"""
