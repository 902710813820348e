"""The fuzzy matcher against its definition, cell by cell, and the time that it takes."""

import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions import fuzzy

LOWEST = float("-inf")


def slow(value, query):
    """M and P as the module's docstring defines them, a cell at a time."""
    if not query or not value:
        return 0
    strict = any("A" <= c <= "Z" for c in query)
    low = lambda c: c.lower() if "A" <= c <= "Z" and not strict else c

    def place(j):
        if j == 1:
            return 16
        before, own = value[j - 2], value[j - 1]
        if before in fuzzy.HARD:
            return 8
        if before in fuzzy.SOFT:
            return 7
        return 6 if "A" <= own <= "Z" and not "A" <= before <= "Z" else 0

    n = len(value)
    matched, skipped, earned = [LOWEST] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
    for ch in query:
        m, p, e = [LOWEST] * (n + 1), [LOWEST] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            if low(value[j - 1]) == ch:
                run = max(earned[j - 1], place(j), 4)
                along, after = matched[j - 1] + run, skipped[j - 1] + place(j)
                m[j], e[j] = max(along, after) + (16 if value[j - 1] == ch else 14), run if along >= after else place(j)
            p[j] = max(m[j - 1] - 4, p[j - 1] - 1)
        matched, skipped, earned = m, p, e
    best = max(matched)
    return 0 if best == LOWEST else best


@settings(max_examples=400, deadline=None)
@given(st.text("abAB1 -/é", max_size=16), st.text("abA1 /é", max_size=5))
def test_scores_are_the_model(value, query):
    assert int(fuzzy.scores([value], query)[0]) == slow(value, query)


def test_batches_of_all_lengths_are_the_model(monkeypatch):
    monkeypatch.setattr(fuzzy, "CELLS", 300)
    rng = random.Random(4)
    values = ["".join(rng.choice("abcAB -_/") for _ in range(rng.randrange(90))) for _ in range(150)] + [None, "", "x" * 9000 + " ab c", "\U0001f642ab"]
    for query in ("ab", "a b", "abc/", "Ab", "c" * 12, "\U0001f642b"):
        assert fuzzy.scores(values, query).tolist() == [slow(v or "", query) for v in values]


def test_known_scores():
    """Worked by hand: 16 a match; 16 at the start of the value, 8 and 7 after signs, 6 at a capital, 4 in a run."""
    score = lambda v, q: int(fuzzy.scores([v], q)[0])
    assert score("a", "a") == -1 + 16 + 16 and score("A", "a") == -1 + 16 + 14 and score("a", "A") == 0 and score("A", "A") == 31
    assert score("ab", "ab") == 31 + 16 + 16  # the run keeps what its first place earned
    assert score("xab", "ab") == -1 + 0 + 16 + 4 + 16 and score("x ab", "ab") == -1 + 8 + 16 + 8 + 16 and score("x-ab", "ab") == -1 + 7 + 16 + 7 + 16
    assert score("xAb", "Ab") == -1 + 6 + 16 + 6 + 16 and score("axb", "ab") == 31 - 4 + 16 and score("axxb", "ab") == 31 - 5 + 16
    assert score("ba", "ab") == 0 and score("", "a") == 0 and score("a", "") == 0


def test_column_is_the_model(spark):
    values = ["foo bar", "FooBar", "f.o*o", "", None, "oof", "f\noo", "ſoo", "Ünder foo", "a^b]c\\d-e&&f[g", "\U0001f642 u"]
    rows = spark.createDataFrame(list(enumerate(values)), "k long, v string").repartition(3)
    for query in ("foo", "Fo", "f.o", "ü", "", "s", "^]\\-&&[", "-&", "\U0001f642u", "f\no"):
        got = {r.k: r.s for r in rows.select("k", fuzzy.fuzzy(F.col("v"), query).alias("s")).collect()}
        assert [got[k] for k in range(len(values))] == [slow(v or "", query) for v in values], query


def test_time_is_linear(spark):
    """Values that almost hold the query take one pass each; 10,000 alignments of 60 characters a few seconds at most."""
    rows = spark.range(200).select(F.repeat(F.lit("ab"), 20_000).alias("v"))
    began = time.perf_counter()
    assert rows.select(fuzzy.fuzzy(F.col("v"), "ab" * 17 + "z").alias("s")).agg(F.sum("s")).first()[0] == 0
    assert time.perf_counter() - began < 20  # 200 values of 40,000 characters; backtracking takes seconds for 95
    query = "abcdefghij" * 6
    values = [" ".join(query) + str(k % 7) for k in range(10_000)]
    began = time.perf_counter()
    assert (fuzzy.scores(values, query) > 0).all()
    assert time.perf_counter() - began < 6
