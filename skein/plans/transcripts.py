"""Conversations written as the session files of each provider, for the ingestion queries,
and the SQL that gives the same sessions straight from the conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest
from . import views

START = "2024-01-01 00:00:00"
UUID = "0a1b2c3d-0000-4000-8000-{}"
SIDE_THREADS = "id string, title string, cwd string, created_at long, updated_at long, rollout_path string, first_user_message string"


def _json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields))


def _time() -> Column:
    """Message times: an hour a conversation, a minute a turn; every seventh turn has none."""
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(START).cast("timestamp")) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    return F.when(F.col("turn") % 7 != 6, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def _hex(conv_id: Column) -> Column:
    return F.lpad(F.lower(F.hex(conv_id)), 12, "0")


def _claude() -> Column:
    text = F.col("text")
    parts = F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("struct<command:string>").alias("input")), F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.struct(F.lit("ls").alias("command")).alias("input")))
    head = [F.concat(F.lit("s"), "conv_id").alias("sessionId"), F.col("role").alias("type"), F.concat(F.lit("/w"), F.col("conv_id") % 5).alias("cwd"), _time().alias("timestamp"), (F.col("turn") % 3 == 2).alias("isMeta")]
    body = F.when(F.col("turn") % 4 == 3, F.concat(F.lit("<local-command-caveat>"), text)).otherwise(text)
    listed = _json(*head, F.struct("role", parts.alias("content")).alias("message"))
    plain = _json(*head, F.struct("role", body.alias("content")).alias("message"))
    line = F.when(F.col("turn") % 2 == 0, listed).otherwise(plain)
    return F.when(F.col("turn") == 1, F.concat(line, F.lit("\nnot json\n\n"), _json(F.lit("last-prompt").alias("type"), F.concat(F.lit("  prompt "), "conv_id").alias("lastPrompt")))).otherwise(line)


def _codex() -> Column:
    message = _json(F.lit("response_item").alias("type"), _time().alias("timestamp"), F.struct(F.lit("message").alias("type"), "role", F.array(F.struct("text")).alias("content")).alias("payload"))
    meta = _json(F.lit("session_meta").alias("type"), F.struct(F.concat(F.lit("c"), "conv_id").alias("id"), F.concat(F.lit("/c"), "conv_id").alias("cwd"), F.lit("2024-01-01T00:00:00Z").alias("timestamp")).alias("payload"))
    call = _json(F.lit("response_item").alias("type"), F.struct(F.lit("function_call").alias("type"), F.lit("f").alias("name")).alias("payload"))
    return F.when((F.col("turn") == 0) & (F.col("conv_id") % 8 == 1), F.concat_ws("\n", meta, call, message)).otherwise(message)


def _cursor() -> Column:
    asked = F.when(F.col("role") == "user", F.concat(F.lit("noise <user_query> "), "text", F.lit(" </user_query> noise"))).otherwise(F.col("text"))
    parts = F.array(F.struct(F.lit("text").alias("type"), asked.alias("text")), F.struct(F.lit("tool_use").alias("type"), F.lit("no").alias("text")))
    return F.when(F.col("turn") % 2 == 0, _json("role", F.struct(parts.alias("content")).alias("message"))).otherwise(_json("role", F.struct(asked.alias("content")).alias("message")))


def _antigravity() -> Column:
    source = F.when(F.col("role") == "assistant", "MODEL").when(F.col("role") == "system", "SYSTEM").when(F.col("turn") % 2 == 0, "USER").otherwise("USER_EXPLICIT")
    calls = F.when(F.col("turn") == 1, F.array(F.struct(F.lit("run").alias("name"), F.struct(F.concat(F.lit("/g"), "conv_id").alias("Cwd")).alias("args"))))
    return _json(source.alias("source"), _time().alias("created_at"), F.concat(F.lit("  "), "text", F.lit("\n")).alias("content"), calls.alias("tool_calls"))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """provider, source_path, mtime_ns, size_bytes, content, error: a file for each conversation; every
    fifteenth cannot be read."""
    rows = views.table(spark, sf_dir, "conversations").withColumn("provider", views.provider_of(F.col("conv_id")))
    of = lambda p: F.col("provider") == p
    line = F.when(of("claude"), _claude()).when(of("codex"), _codex()).when(of("cursor"), _cursor()).otherwise(_antigravity())
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n")
    made = rows.groupBy("provider", "conv_id").agg(F.concat(body, F.lit("\r\n")).alias("content"))
    path = (
        F.when(of("claude"), F.concat(F.lit("/h/claude/p/f"), "conv_id", F.lit(".jsonl"))).when(of("codex"), F.concat(F.lit("/h/codex/rollout-0a1b2c3d-0000-4000-8000-"), _hex(F.col("conv_id")), F.lit(".jsonl")))
        .when(of("cursor"), F.concat(F.lit("/h/cursor/proj"), F.col("conv_id"), F.lit("/agent-transcripts/k/k"), "conv_id", F.lit(".jsonl"))).otherwise(F.concat(F.lit("/h/gem/conv"), "conv_id", F.lit("/.system_generated/logs/transcript.jsonl")))
    )
    mtime = F.unix_micros(F.lit(START).cast("timestamp")) * 1000 + F.col("conv_id") * 1_000_000_123
    bad = F.col("conv_id") % 15 == 14
    return made.select("provider", path.alias("source_path"), mtime.alias("mtime_ns"), F.octet_length("content").cast("long").alias("size_bytes"), F.when(~bad, F.col("content")).alias("content"), F.when(bad, "UnicodeDecodeError: bad").alias("error"))


def side(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Side tables for some of codex's files: threads, and titles of the index."""
    convs = views.table(spark, sf_dir, "conversations").select("conv_id").distinct().where("conv_id % 4 = 1")
    uuid = F.concat(F.lit("0a1b2c3d-0000-4000-8000-"), _hex(F.col("conv_id")))
    own = F.when(F.col("conv_id") % 8 == 1, F.concat(F.lit("c"), "conv_id")).otherwise(uuid)
    threads = convs.where("conv_id % 3 = 0").select(own.alias("id"), F.when(F.col("conv_id") % 2 == 1, F.concat(F.lit("Side "), "conv_id")).alias("title"), F.lit("/side").alias("cwd"), F.lit(60).cast("long").alias("created_at"), F.lit(120).cast("long").alias("updated_at"), F.lit("/r").alias("rollout_path"), F.lit("Side first").alias("first_user_message"))
    titles = convs.where("conv_id % 5 = 0").select(own.alias("id"), F.concat(F.lit("Index "), "conv_id").alias("thread_name"))
    return threads, titles


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions that ingestion makes of those files."""
    return ingest.sessions(ingest.decoded(contents(spark, sf_dir)), *side(spark, sf_dir), **LOOKUPS)


def _repo(cwd: str | None) -> str | None:
    return cwd if cwd and cwd[-1] in "02468" else None


def _workspace(project: str | None) -> str | None:
    return "/u/" + project if project and not project.endswith("2") else None


#: In the place of a look at directories.
LOOKUPS = {"repo_root": _repo, "workspace": _workspace}


_TRIM = "trim(regexp_replace({}, '^[\\s\\x{{85}}\\p{{Z}}]+|[\\s\\x{{85}}\\p{{Z}}]+$', '', 'g'))"
_ISO = f"timestamp '{START}' + to_hours(cast(conv_id as int)) + to_minutes(cast(turn as int))"
_MTIME = f"timestamp '{START}' + to_microseconds(conv_id * 1000000 + conv_id * 123 // 1000)"


def _substantive(c: str) -> str:
    return views.SUBSTANTIVE.replace("regexp_replace(text,", f"regexp_replace({c},")


#: What each line says, straight from the conversations: role, text, time, whether the transcript keeps it.
LINES_SQL = f"""raw as (select *, (['claude','codex','cursor','antigravity'])[conv_id % 4 + 1] as provider, {_TRIM.format('text')} as t,
  case when turn % 7 <> 6 then {_ISO} end as iso from conversations),
said as (select conv_id, turn, provider, role, iso,
  case when provider = 'claude' and turn % 2 = 1 and turn % 4 = 3 then '<local-command-caveat>' || {_TRIM.format('text || chr(32)')} else t end as body,
  case provider when 'cursor' then {_MTIME} else iso end as tm from raw),
kept as (select *, role in ('user', 'assistant') and body <> '' and case provider
    when 'claude' then not ((turn % 3 = 2 and contains(body, '<local-command-caveat>')) or {views.ASCII.format('body')} = 'resume cancelled')
    when 'cursor' then {_substantive('body')} else true end as keep,
  role = 'user' and (provider = 'codex' or {_substantive('body')}) as asks from said),
files as (select provider, conv_id, arg_min(body, turn) filter (keep and asks) as first_user, arg_max(body, turn) filter (keep and asks) as last_user, count(*) filter (keep) as message_count,
  arg_min(tm, turn) filter (tm is not null and (keep or provider = 'antigravity')) as first_at, arg_max(tm, turn) filter (tm is not null and (keep or provider = 'antigravity')) as last_at,
  count(*) + case provider when 'claude' then 3 * count(*) filter (turn = 1) when 'codex' then case when conv_id % 8 = 1 then 2 * count(*) filter (turn = 0) else 0 end else 0 end as line_count,
  count(*) filter (turn = 0) > 0 as has_0, count(*) filter (turn = 1) > 0 as has_1,
  coalesce(string_agg('[' || coalesce(strftime(tm, '%Y-%m-%d %H:%M:%S UTC'), 'unknown-time') || '] ' || role || chr(10) || body, chr(10) || chr(10) order by turn) filter (keep), '') as transcript_text
  from kept group by provider, conv_id)"""

_UUID = "'0a1b2c3d-0000-4000-8000-' || lpad(lower(to_hex(conv_id)), 12, '0')"
_PATH = f"""case provider when 'claude' then '/h/claude/p/f' || conv_id || '.jsonl' when 'codex' then '/h/codex/rollout-' || {_UUID} || '.jsonl'
  when 'cursor' then '/h/cursor/proj' || conv_id || '/agent-transcripts/k/k' || conv_id || '.jsonl' else '/h/gem/conv' || conv_id || '/.system_generated/logs/transcript.jsonl' end"""

SESSIONS_SQL = f"""{LINES_SQL},
named as (select *, {_PATH} as source_path, conv_id % 15 = 14 as bad, provider = 'codex' and conv_id % 3 = 0 as has_thread, conv_id % 8 = 1 and has_0 as has_meta,
  case when provider = 'codex' and conv_id % 3 = 0 and conv_id % 2 = 1 then 'Side ' || conv_id end as side_title, case when provider = 'codex' and conv_id % 5 = 0 then 'Index ' || conv_id end as index_title,
  case when provider = 'claude' and has_1 then 'prompt ' || conv_id when provider = 'antigravity' then last_user end as prompt,
  case provider when 'claude' then 's' || conv_id when 'codex' then case when conv_id % 8 = 1 and has_0 then 'c' || conv_id else {_UUID} end when 'cursor' then 'k' || conv_id else 'conv' || conv_id end as psid,
  case provider when 'claude' then 'f' || conv_id when 'codex' then 'rollout-' || {_UUID} when 'cursor' then 'k' || conv_id else 'transcript' end as stem from files),
shaped as (select *, case when provider = 'codex' then coalesce(side_title, index_title, first_user) else coalesce(prompt, last_user, first_user) end as title_of,
  case when provider = 'codex' then coalesce(case when has_thread then 'Side first' end, first_user) else first_user end as summary_of,
  case provider when 'claude' then '/w' || conv_id % 5 when 'codex' then coalesce(case when has_meta then '/c' || conv_id end, case when has_thread then '/side' end)
    when 'cursor' then case when conv_id % 10 <> 2 then '/u/proj' || conv_id end else case when has_1 then '/g' || conv_id end end as cwd_of from named),
whole as (select *, {views._bytes_cut('summary_of', 180)} as summary_cut from shaped),
previewed as (select *, case when provider = 'codex' then coalesce(last_user, first_user, summary_cut) else coalesce(prompt, last_user, first_user) end as shown from whole),
ingested as (
  select provider || ':' || psid as id, provider, psid as provider_session_id, {views._bytes_cut('title_of', 100)} as title, summary_cut as summary, cwd_of as cwd,
    case when right(cwd_of, 1) in ('0', '2', '4', '6', '8') then cwd_of end as repo_root,
    case when provider = 'codex' then coalesce(case when has_meta then timestamp '2024-01-01 00:00:00' end, case when has_thread then timestamp '1970-01-01 00:01:00' end) else first_at end as created_at,
    case provider when 'cursor' then {_MTIME} when 'codex' then coalesce(last_at, case when has_thread then timestamp '1970-01-01 00:02:00' end) else last_at end as updated_at,
    coalesce(case when {_TRIM.format('shown')} = '' then '(no preview available)' else {views._bytes_cut('shown', 140)} end, '(no preview available)') as preview_text,
    source_path, message_count, provider || '-v1' as parse_version, null as parse_warning, case when provider = 'codex' then 'jsonl+sqlite' else 'jsonl' end as discovery_source, transcript_text, line_count
  from previewed where not bad
  union all
  select provider || ':' || stem, provider, stem, null, null, null, null, null, null, '(parse failed)', source_path, 0, provider || '-v1', 'UnicodeDecodeError: bad', 'jsonl', '', null from named where bad)"""
