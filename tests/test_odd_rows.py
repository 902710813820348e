"""Queries over rows that the smallest tables lack give the rows of their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_oracle import normal

from skein.functions import fuzzy, udfs
from skein.operators import ingest, render
from skein.plans import registry

#: Says undder, 18 letters apart: the gaps cost more than the letters earn.
FAR_APART = "x" + ("x" * 18).join("undder")


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """A folder of tables, and DuckDB that has them as views: conversations of each provider, times of whole
    milliseconds, of whole seconds and with microseconds."""
    at, db = str(tmp_path_factory.mktemp("odd")), duckdb.connect()
    made = {
        "conversations": f"""select conv_id, turn, case turn when 0 then 'user' else 'assistant' end as role, case when turn = 0 and conv_id % 3 = 0 then '{FAR_APART}' else 'und der ' || conv_id || ' ' || turn end as text
          from range(130, 160) c(conv_id), range(2) t(turn)""",
        "events": """select c * 2 + k as event_id, c * 2 as user_id, timestamp '2024-01-01 10:00:00' + to_microseconds(k * 1000000 + (array[43000, 0, 500000, 123456])[c // 4 % 4 + 1]) as ts from range(130, 159) t(c), range(2) u(k)""",
        "documents": "select doc_id, 'src' || doc_id % 3 as source from range(130, 160) t(doc_id)",
    }
    for name, sql in made.items():
        db.sql(f"copy ({sql}) to '{at}/{name}.parquet'")
        db.sql(f"create view {name} as select * from '{at}/{name}.parquet'")
    return at, db


@pytest.mark.parametrize("name", ["ingested_sessions", "parse_cursor", "export_json", "session_detail", "export_markdown", "fuzzy_title"])
def test_query(spark, odd, name):
    at, db = odd
    got, want = registry.queries()[name](spark, at).toPandas(), db.sql(registry.oracle_sql()[name]).df()
    assert len(got) and sorted(got.columns) == sorted(want.columns) and normal(got) == normal(want)


def test_file_times_are_cut_to_microseconds(spark):
    """18 digits of nanoseconds are more than a double has; before 1970, too, the earlier microsecond is taken."""
    times = [1_704_067_338_000_016_974, 1_704_067_338_000_016_000, 1_704_067_338_999_999_999, -1, -1000]
    rows = spark.createDataFrame([(t, "cursor", "x", "user", False, None) for t in times], "mtime_ns long, provider string, text string, role string, is_meta boolean, ts string")
    got = {r[0]: r[1] for r in ingest.messages(rows).select("mtime_ns", F.unix_micros("mtime")).collect()}
    assert got == {t: t // 1000 for t in times}


def test_separators_are_no_white_space(spark, tmp_path):
    """U+001C to U+001F at the ends of Cursor's texts, or alone, stay, as in the SQL; other white space goes."""
    texts = [t for c in "\x1c\x1d\x1e\x1f\x1b \n\x85\xa0\u2003\u2028\u3000\u200b" for t in (f"{c}und{c}der{c}", c, f" {c} /exit {c}\n")]
    rows = [(4 * k + 2, turn, role, t) for k, t in enumerate(texts) for turn, role in enumerate(("user", "assistant", "assistant", "user"))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got, want = registry.queries()["parse_cursor"](spark, str(tmp_path)).toPandas(), db.sql(registry.oracle_sql()["parse_cursor"]).df()
    assert len(got) and normal(got) == normal(want)
    assert udfs.tagged("<t> \x1ca\x1f\n</t>", "t") == "\x1ca\x1f"
    assert all((chr(k) in udfs.SPACES) == (chr(k).isspace() and not 0x1C <= k <= 0x1F) for k in range(0x110000))


def test_fractions_of_seconds(spark):
    """Three digits where they say all, as the engine prints times, or always six; before 1970 too."""
    micros = [0, 43_000, 500_000, 123_456, 1_000, 1, -1_000, -1]
    rows = spark.createDataFrame([(k, m) for k, m in enumerate(micros)], "k long, m long").withColumn("t", F.timestamp_micros("m"))
    got = [tuple(r) for r in rows.orderBy("k").select(render.rfc3339(F.col("t")), render.rfc3339(F.col("t"), millis=False)).collect()]
    parts = [("", ""), (".043", ".043000"), (".500", ".500000"), (".123456", ".123456"), (".001", ".001000"), (".000001", ".000001"), (".999", ".999000"), (".999999", ".999999")]
    assert got == [tuple(f"{'1970-01-01T00:00:00' if m >= 0 else '1969-12-31T23:59:59'}{p}+00:00" for p in own) for m, own in zip(micros, parts)]


def test_no_fuzzy_score_is_below_zero(spark):
    """An alignment whose gaps cost more than its matches earn counts as none."""
    assert fuzzy.scores([FAR_APART], "undder")[0] == -1 + 6 * 16 - 5 * (3 + 18)
    rows = spark.createDataFrame([(FAR_APART,), ("undder",)], "v string")
    assert [r[0] for r in rows.select(fuzzy.fuzzy(F.col("v"), "undder")).collect()] == [0, -1 + 6 * (16 + 16)]
