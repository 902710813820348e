"""Column functions against plain models."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions import text, udfs


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k long, v {kind}")
    return [r[0] for r in rows.select("k", make(F.col("v")).alias("r")).orderBy("k").select("r").collect()]


def test_truncated_is_the_byte_model(spark):
    values = ["", "a", "a  b\t\nc", "é" * 60, "漢字" * 40, "\U0001f642" * 30, "x" * 99 + "é", "x" * 100, "x" * 101, "   y ", "ab cd" * 20]
    assert column(spark, values, lambda c: text.truncated(c, 100)) == [udfs.truncate(v, 100) for v in values]
    assert all(len(v.encode()) <= 100 for v in column(spark, values, lambda c: text.truncated(c, 100)))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80), st.integers(4, 60))
def test_truncate_model_keeps_whole_characters(value, n):
    out = udfs.truncate(value, n)
    assert len(out.encode()) <= n and (out == udfs.compact(value) or out.endswith("..."))


def test_preview(spark):
    blank, short, cut, whole = column(spark, ["\u00a0\n", "  kept as\tit is ", "ü" * 71, "ü" * 70], text.preview)
    assert blank == "(no preview available)" and short == "kept as it is"
    assert cut == "ü" * 68 + "..." and whole == "ü" * 70  # 137 bytes hold 68 letters of two bytes


def test_highlight(spark):
    mark = lambda q, v: column(spark, [v], lambda c: text.highlighted(c, q))[0]
    assert mark("Ärger", "viel ärger und ÄRGER.") == "viel [[ärger]] und [[ÄRGER]]."
    assert mark("the", "The end of the") == "[[The]] end of [[the]]"  # a whole query is marked, stop word or not
    assert mark("the rain", "the RAIN, a rain, the") == "[[the RAIN]], a [[rain]], the"
    assert mark("a.b", "a.b axb") == "[[a.b]] axb"
    assert mark("  ", "x") == "x"
    assert text.highlight_terms("of Cat cat at") == ["of Cat cat at", "Cat"]


def test_moment(spark):
    got = column(spark, ["2024-01-02T03:04:05Z", "2024-01-02t03:04:05.5+02:00", "2024-01-02", "2024", "2024-01-02T03:04:05", "x", None], text.moment)
    assert got[:3] == [dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 1, 4, 5, 500000), dt.datetime(2024, 1, 2)] and got[3:] == [None] * 4


def test_relative_age(spark):
    at = dt.datetime(2024, 3, 1, 12)
    values = [None, at + dt.timedelta(days=2), at - dt.timedelta(seconds=59), at - dt.timedelta(minutes=5), at - dt.timedelta(hours=23, minutes=59), at - dt.timedelta(days=29), at - dt.timedelta(days=30)]
    assert column(spark, values, lambda c: text.relative_age(c, text.as_timestamp(at)), "timestamp") == ["-", "just now", "just now", "5m ago", "23h ago", "29d ago", "2024-01-31"]


def test_substantive_and_skipped(spark):
    values = ["hi", "  ", "/EXIT", "Resume Cancelled", "x <local-command-stdout> y", "<command-name>/model</command-name>", "I'll start by studying"]
    assert column(spark, values, text.substantive) == [True] + [False] * 6
    caveat = text.CAVEAT_MARKS[0] + " x"
    skip = lambda v, meta: column(spark, [v], lambda c: text.skipped(c, F.lit(meta)))[0]
    assert skip(caveat, True) and not skip(caveat, False) and skip("<command-name>/exit</command-name>", False) and not skip("hello", True)


def test_prefix_is_like_without_case(spark):
    values = ["/Repo/a_b", "/repo/axb", "/REPO/a\\b", None]
    assert column(spark, values, lambda c: text.starts_like(c, "/repo/a_")) == [True, True, True, False]
    assert column(spark, values, lambda c: text.starts_like(c, "/repo/a\\")) == [False, False, True, False]
    assert column(spark, ["ÉCOLE"], lambda c: text.starts_like(c, "éc")) == [False]


def test_first_lines(spark):
    assert column(spark, ["a\r\nb\nc\n", "", "x"], lambda c: text.first_lines(c, 2)) == ["a\nb", "", "x"]
    assert column(spark, ["a"], lambda c: text.first_lines(c, 0)) == [""]


def test_tokens(spark):
    assert column(spark, ["Été, naïve-FOO_2 über"], text.tokens) == [["ete", "naive", "foo", "2", "uber"]]
    assert text.query_terms("Été foo-bar --") == [["ete"], ["foo", "bar"]]


def test_snippet():
    assert udfs.snippet_of("", "x") == udfs.snippet_of(" \n", "x") == "(no snippet available)"
    # 10 bytes on either side, moved outwards to whole letters
    assert udfs.snippet_of("ab" * 20 + "KEY" + "é" * 20, "key", 20) == "..." + "ab" * 5 + "KEY" + "é" * 5 + "..."
    assert udfs.snippet_of("é" * 50 + "needle" + "é" * 50, "NEEDLE", 21).count("é") == 10
    assert udfs.snippet_of("key at the start", "key", 8) == "key at ..." and udfs.snippet_of("the end is key", "key", 8) == "... is key"
    # the whole query first, then its words in order, then the start of the text
    assert udfs.snippet_of("one two, two three", "two three", 2) == "... two three" and udfs.snippet_of("late word, early", "none early late", 2) == "... early"
    assert udfs.snippet_of("a  b\tc", "zz d", 160) == "a b c" and udfs.snippet_of("x" * 30, "q", 10) == "x" * 7 + "..."


def turn(role, body):
    return f"[2024-05-06 07:08:09 UTC] {role}\n{body}"


def test_turns():
    own = "\n\n".join([turn("user", "first\n\nwith a gap"), turn("assistant", "[1] a list\n[2] user manual"), turn("user", "")])
    assert udfs.turns_of("lost words\n" + own) == [("user", "first\n\nwith a gap"), ("assistant", "[1] a list\n[2] user manual"), ("user", "")]
    assert udfs.turns_of(turn("system", "x")) == [] and udfs.turns_of(turn("user", "a") + "\n[no role\n[t]  user \nb") == [("user", "a\n[no role"), ("user", "b")]
    assert udfs.turns_of(None) == [] and udfs.turns_of("[t] user\r\nline\r\n") == [("user", "line")]


def test_summary():
    five = "\n\n".join(turn(r, b) for r, b in [("assistant", "opens"), ("user", "asks"), ("user", "asks more"), ("assistant", "works"), ("user", "closes")])
    assert udfs.summary_of(five) == "\n\n".join(["── First reply ──", "opens", "── First prompt ──", "asks", "⋯ 1 more turn hidden ⋯", "── Final reply ──", "works", "── Final prompt ──", "closes", "(5 turns total)"])
    assert udfs.summary_of(turn("user", "alone \n\n")) == "── First prompt ──\n\nalone\n\n(1 turn total)"
    assert udfs.summary_of("no header") == "(no transcript content)"
    assert udfs.body_head("a\nb\nc", 3) == "a\nb\nc" and udfs.body_head("a\nb\nc\nd", 3) == "a\nb\nc\n  […]" and udfs.body_head("\n \t", 3) == "(empty)"


def test_text_in():
    nested = {"output": "last", "text": " own ", "input": ["in", {"text": 5, "content": "deep"}], "message": {"text": " "}, "content": [{"type": "x", "text": "c"}], "thinking": "never"}
    assert udfs.text_in(nested) == "own\nc\nin\ndeep\nlast"  # text, content, message, input, output
    assert udfs.text_in([1, None, "  ", {"args": {"text": "no"}}]) == "" and udfs.text_in("\u00a0x ") == "x"


def test_scan_is_the_index(spark):
    from skein.operators import fts

    rows = spark.createDataFrame([(1, "a b c", "d a"), (2, "b a-b", None), (3, "", "c d"), (4, "Été été x", "a b"), (5, "x y", "z")], "id long, p string, q string")
    for query in ("a", "a b", "a-b", "ete zz", "c-d", "x a-b b", " -- "):
        indexed = fts.top(fts.postings(rows, ("p", "q")), fts.lengths(rows, ("p", "q")), query, 10).collect()
        assert [tuple(r) for r in fts.top_scanned(rows, query, 10, ("p", "q")).collect()] == [tuple(r) for r in indexed]


def test_json_line():
    assert udfs.json_line('{"a": 1} x') is None and udfs.json_line('{"a": NaN}') is None and udfs.json_line('{"a":1,"a":2}') == {"a": 2}
