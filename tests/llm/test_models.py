"""Trained operators on held-out rows, the codec's round trip and parity, mixing, licenses and the pipeline."""

import math
import struct
import time
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import common, html_labeller, language, licenses, mixing, queries, quality, sentencepiece_codec, toxicity

ODD = [(None, "a b"), (1, None), (2, ""), (2, ""), (3, "42 !?"), (4, "Word und " * 20_000), (None, None)]


def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", t, 0.5, 1) for i, t in ODD], "doc_id long, text string, lang string, source string, Text string, score double, predicted int")


def tables(spark, sf_dir, *names):
    return [common.table(spark, sf_dir, n) for n in names]


def test_toxicity_held_out(spark, sf_dir):
    docs, labels = tables(spark, sf_dir.replace("0.001", "0.1"), "documents", "labels")
    got = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    y, s = got.toxic.to_numpy(), got.score.to_numpy()
    assert len(got) == labels.where(common.fold(F.col("doc_id"), 5) == 0).count()
    assert ((s >= 0.5) == (got.predicted == 1)).all()
    assert (s[y == 1] >= 0.5).mean() >= 0.85 and (s[y == 0] >= 0.5).mean() <= 0.02
    out = toxicity.toxicity_scores(odd(spark), labels).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.toxicity_scores(odd(spark).limit(0), labels.limit(0)).count() == 0


def test_toxicity_sample_is_not_cut():
    assert toxicity.SAMPLE_ROWS >= 12_000


def test_ftrl_is_sparse_and_separates():
    rows = [(f"some plain words number {k} {'awful mess' if k % 3 == 0 else 'kind note'}", int(k % 3 == 0)) for k in range(150)]
    m = toxicity.train(rows, l1=1.0)
    s = toxicity.score_texts(m, m.dense(), ["an awful mess", "a kind note", "", None])
    assert s[0] > 0.5 > s[1] and len(m.index) < 40 and s[2] == s[3]
    none = toxicity.train([])
    assert toxicity.score_texts(none, none.dense(), ["x"])[0] < 0.5


def test_language_held_out(spark, sf_dir):
    (docs,) = tables(spark, sf_dir.replace("0.001", "0.01"), "documents")
    got = language.identify_languages(docs).withColumnRenamed("lang_pred", "p").join(docs, "doc_id").where("held_out").select("p", "lang", "score").toPandas()
    assert (got.p == got.lang).mean() > 0.97 and got.score.between(0, 1).all()
    out = {(r["doc_id"], r["lang_pred"]) for r in language.identify_languages(odd(spark)).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (None, "und"), (4, "en")} <= out
    assert language.identify_languages(odd(spark).limit(0)).count() == 0


def test_windows_cover_whole_texts():
    w = language.windows_of(b"x" * (language.WINDOW * 2 + 1))
    assert w.shape == (3, language.WINDOW) and (w != 0).sum() == language.WINDOW * 2 + 1


def test_quality_held_out(spark, sf_dir):
    docs, labels = tables(spark, sf_dir.replace("0.001", "0.1"), "documents", "labels")
    got = quality.quality_grades(docs, quality.grade_table(labels)).join(labels, "doc_id").where("held_out").toPandas()
    good = got.quality == 1
    assert (got.selected == good).mean() > 0.98 and got.selected[good].mean() > 0.99 and got.expected_grade.between(0, 2).all()
    toxic = good & (got.toxic == 1)
    assert got.expected_grade[toxic].mean() < got.expected_grade[good & ~toxic].mean() and got.expected_grade[~good].mean() < 0.2
    assert len(quality.quality_grades(odd(spark), quality.grade_table(labels)).collect()) == len(ODD)
    assert quality.quality_grades(odd(spark), quality.grade_table(labels).limit(0)).where("expected_grade <> 0").count() == 0


def test_ordinal_thresholds_are_ordered():
    rows = [(" ".join(["bad"] * (4 - g) + ["good"] * g), g) for g in range(5) for _ in range(40)]
    m = quality.train(rows, epochs=20)
    assert (np.diff(m.thresholds) > 0).all() and m.grades == [0, 1, 2, 3, 4]
    margins = m.margins([rows[k * 40][0] for k in range(5)])
    assert (np.diff(margins) > 0).all() and (np.diff(m.reach(margins), axis=1) <= 0).all()


class Article(HTMLParser):
    """The text blocks inside of article elements, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.parts, self.blocks = 0, [], []

    def handle_starttag(self, tag, attrs):
        self.cut(tag)
        self.open += tag == "article"

    def handle_endtag(self, tag):
        self.cut(tag)
        self.open -= tag == "article"

    def handle_data(self, data):
        if self.open:
            self.parts.append(data)

    def cut(self, tag):
        if tag == "br":
            self.parts.append(" ")
        elif tag not in ("a", "b", "i", "em", "strong", "span", "code", "img", "u", "small", "sup", "sub"):
            text = " ".join("".join(self.parts).split())
            self.blocks += [text] * bool(text)
            self.parts = []


def article_of(page):
    p = Article()
    p.feed(page)
    p.close()
    return "\n".join(p.blocks)


def test_grades_by_the_formula(spark):
    """Shares of hashed features, cumulative links and the expected grade, one text at a time."""
    rows = [(" ".join(["bad"] * (3 - g) + ["good"] * g + [f"w{k}"]), g) for g in range(4) for k in range(30)]
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id long, text string")
    graded = spark.createDataFrame([(k, g) for k, (_, g) in enumerate(rows)], "doc_id long, grade int")
    m = quality.train(common.labelled_sample(docs, graded, "grade", quality.FOLDS, quality.HELD_OUT, 1000))
    got = {r["doc_id"]: r for r in quality.quality_grades(docs, graded, reach=2).collect()}
    for k, (t, _) in enumerate(rows):
        index, share = quality.features(t)
        margin = sum(float(m.weight[i]) * float(v) for i, v in zip(index, share))
        above = [1 / (1 + math.exp(c - margin)) for c in m.thresholds]  # P(grade >= 1), ...
        p = [1 - above[0], above[0] - above[1], above[1] - above[2], above[2]]
        assert min(p) > 0 and sum(p) == pytest.approx(1)
        assert got[k]["expected_grade"] == pytest.approx(sum(g * x for g, x in enumerate(p)), abs=1e-4)
        assert got[k]["tail_probability"] == pytest.approx(above[1], abs=1e-4) and got[k]["selected"] == (got[k]["tail_probability"] >= 0.5)


def test_pieces_are_bounded():
    texts = ["x" * n for n in (5, 0, 30, 5, 5, 5, 100, 1)] + [None, "é" * 4]
    got = list(common.pieces([pa.array(texts[:6]), pa.array(texts[6:])], 12))
    assert [t for own in got for t in own] == texts and all(len(own) == 1 or sum(len((t or "").encode()) for t in own) <= 12 for own in got)
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(10))], names=["t", "k"])
    assert [k for b in common.row_pieces([batch], "t", 12) for k in b.column("k").to_pylist()] == list(range(10))
    assert list(common.pieces([pa.array([], pa.string())])) == []


def test_samples_are_bounded_by_bytes(spark):
    docs = spark.createDataFrame([(k, "x" * 100) for k in range(50)] + [(3, "y" * 100)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id long, toxic int")
    chosen = labels.where("doc_id % 2 = 0").select("doc_id")
    sample = lambda n, size: [t for t, _ in common.texts_of(docs.withColumn("toxic", F.lit(1)), chosen, "toxic", n, size)]
    assert len(sample(100, 10**6)) == 25 and len(sample(7, 10**6)) == 7 and len(sample(100, 1650)) == 16
    assert sample(100, 1650) == sample(100, 10**6)[:16]
    with pytest.raises(ValueError, match="all labelled texts"):  # and no untrained model
        sample(100, 16 * 100 - 1)
    assert sample(0, 10**6) == [] and list(common.texts_of(docs.withColumn("toxic", F.lit(1)).limit(0), chosen, "toxic", 9)) == []
    long = spark.createDataFrame([(k, "z" * 5_000_000 if k % 3 else f"short {k}") for k in range(12)], "doc_id long, text string").withColumn("toxic", F.lit(1))
    assert sorted(t for t, _ in common.texts_of(long, long.select("doc_id"), "toxic", 100)) == ["short 0", "short 3", "short 6", "short 9"]  # long texts shut out no others
    both = [list(common.labelled_sample(d, labels, "toxic", 5, 0, 1000)) for d in (docs, docs.repartition(3))]
    assert both[0] == both[1] and all(y == 1 or t[0] in "xy" for t, y in both[0])


def test_html(spark, sf_dir):
    net = html_labeller.trained()
    page = """<html><head><title>T</title><script>var a="</p><p>no";</script></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/a>About us</a></li></ul></nav>
    <div class="ad">Buy now</div><article><h1>A  &amp; B&nbsp;head</h1><p>First <b>para</b> of the text, with some words.<br><p>Second one &eacute; here, as long as the first.</p></article>
    <div class="comments"><div class="comment"><p>Great post, thanks</p></div></div><footer>&copy; all rights reserved</footer></body></html>"""
    assert html_labeller.extract(net, [page, None, ""]) == ["A & B head\nFirst para of the text, with some words.\nSecond one é here, as long as the first.", "", ""]
    for page in ("5 < 6 <!-- secret <![CDATA[ x", "5 < 6 <!-- secret", "5 < 6"):  # what opens first decides, also where no tag ends any more
        assert [b.text for b in html_labeller.blocks_of(page)] == ["5 < 6"]
    assert "".join(b.text for b in html_labeller.blocks_of("5 < 6 <![CDATA[ x <!-- y")).replace(" ", "") == "5<6x<!--y"
    assert [b.text for b in html_labeller.blocks_of("a < b<br>c <i>d</i><style>x</style><!-- y --><p>&am z")] == ["a < b c d", "&am z"]
    rng = np.random.default_rng(77)
    wrong = total = 0
    for _ in range(60):
        made, wanted = html_labeller.made_page(rng)
        blocks = html_labeller.blocks_of(made)
        labels = net.label([blocks])[0]
        wrong += sum((b.text in wanted) != k for b, k in zip(blocks, labels))
        total += len(blocks)
    assert wrong < 0.03 * total
    (pages,) = tables(spark, sf_dir, "pages")
    got = {r["page_id"]: r for r in html_labeller.extract_pages(pages).collect()}
    right = 0
    for r in pages.collect():
        right += got[r["page_id"]]["text"] == article_of(r["html"])
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])
    assert right >= 0.96 * len(got)
    strange = spark.createDataFrame([(None, None, None, "x"), (1, "u", "", "x"), (1, "u", "<p>" * 300 + "deep", "x")], "page_id long, url string, html string, text string")
    assert html_labeller.extract_pages(strange).count() == 3 and html_labeller.extract_pages(strange.limit(0)).count() == 0


def test_long_pages_are_read_as_a_whole(monkeypatch):
    net = html_labeller.trained()
    page = "<nav><a href=/>Home</a></nav><article>" + "<p>Some words of the long text here.</p><ul><li>an item of it</li><li>one more, and longer.</li></ul>" * 500 + "</article><footer>end</footer>"
    blocks = html_labeller.blocks_of(page)
    chunked = net._long(blocks)
    x, mask = html_labeller._padded(html_labeller.vectors_of([blocks]))
    whole, _ = net.logits(x, mask)
    assert len(blocks) == 1502 and np.allclose(whole[:, 0], chunked, atol=1e-4)
    assert (net.label([blocks])[0] == (chunked > 0)).all() and (chunked[1:-1] > 0).mean() > 0.9


@pytest.mark.parametrize(
    "page",
    ["<a " * 1_700_000, "<a \"x>\" " * 600_000, "<div>" * 100_000 + "deep" + "</x>" * 100_000, "<div>" * 50_000 + "<li>x" * 50_000, "</p>" * 500_000, "<script>" * 300_000, "<!-- " * 500_000, "&amp" * 500_000, "<p>" * 400_000, "< " * 1_000_000, "<b><p>" * 100_000],
    ids=range(11),
)
def test_cutting_takes_linear_time(page):
    began = time.perf_counter()
    html_labeller.blocks_of(page)
    assert time.perf_counter() - began < 20


def test_references_end_with_their_run():
    blocks = lambda t: [b.text for b in html_labeller.blocks_of(t)]
    assert blocks("<p>&am<b>p;</b> x &lt;b&gt; &amp;lt;</p>") == ["&amp; x <b> &lt;"]
    assert blocks("<p>a <![CDATA[b &amp; c]]> d<!-- e --> f</p>") == ["a b &amp; c d f"]
    assert blocks("a <b title='x>y'>c</b> d < e <f") == ["a c d < e <f"]


def test_codec(spark, sf_dir):
    data = open(sentencepiece_codec.default_model(), "rb").read()
    texts = [r["text"] for r in tables(spark, sf_dir, "documents")[0].collect()] + ["▁", "a\n\nb", " x", "x ", "\x00", "💥" * 5, "1 234", "<0x41>", "word" * 5000]
    assert sentencepiece_codec.verify_parity(data, texts) == []
    codec = sentencepiece_codec.Codec(data)
    plain = [t for t in texts if "▁" not in t]
    assert codec.decode(codec.encode(plain)) == plain
    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    some = [[1, 5, 300, 301, 2], [], [0], [259, 100]]
    assert codec.decode(some)[1] == "" and codec.decode(some)[0] == sp.decode(some[0])
    out = sentencepiece_codec.encode_documents(odd(spark).withColumn("n_tokens", F.lit("x"))).collect()
    assert len(out) == len(ODD) and all(r["round_trip"] and r["n_tokens"] == len(r["token_ids"]) for r in out)
    assert sentencepiece_codec.encode_documents(odd(spark).limit(0)).count() == 0


def field(n, value):
    """A field of a protobuf message."""
    if isinstance(value, int):
        return bytes([n << 3, value]) if n < 16 else bytes([(n << 3) & 127 | 128, n >> 4, value])
    size = len(value)
    return bytes([n << 3 | 2]) + (bytes([size]) if size < 128 else bytes([size & 127 | 128, size >> 7])) + value


def made_model(pieces, *trainer):
    body = b"".join(field(1, field(1, p if isinstance(p, bytes) else p.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", s) + field(3, k)) for p, s, k in pieces)
    return body + field(2, b"".join(trainer)) + field(3, field(1, b"identity"))


def test_unigram_model():
    data = made_model([("<unk>", 0.0, 2), ("▁a", -1.0, 1), ("b", -2.0, 1), ("ab", -1.5, 1), ("▁", -3.0, 1), ("a", -2.5, 1)], field(3, 1))
    assert sentencepiece_codec.verify_parity(data, ["ab a", "b", "aab  ab", ""]) == []


def test_unigram_model_with_byte_fallback():
    """Scores decide between lattices; what no piece spells becomes bytes, and comes back."""
    rng = np.random.default_rng(13)
    words = sorted({"".join(rng.choice(list("abcde"), rng.integers(2, 6))) for _ in range(120)})
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), *((f"<0x{k:02X}>", 0.0, 6) for k in range(256)), ("▁", -4.0, 1)]
    pieces += [(c, -6.0 - k / 7, 1) for k, c in enumerate("abcde")] + [(w if k % 2 else "▁" + w, -float(rng.uniform(5, 14)), 1) for k, w in enumerate(words)]
    data = made_model(pieces, field(3, 1), field(35, 1))
    model = sentencepiece_codec.PieceModel.parse(data)
    assert model.kind == sentencepiece_codec.UNIGRAM and model.byte_fallback and len(model.pieces) == len(pieces)
    texts = [" ".join("".join(rng.choice(list("abcdeé漢\U0001f642z"), rng.integers(1, 9), p=[0.18] * 5 + [0.03, 0.03, 0.02, 0.02])) for _ in range(rng.integers(1, 30))) for _ in range(200)]
    texts += ["", " ", "a\nb", "zzz", "é", "ab  ab", "\ta"]
    codec = sentencepiece_codec.Codec(data)
    coded = codec.encode(texts)
    theirs = sentencepiece.SentencePieceProcessor(model_proto=data)
    score = lambda ids: sum(-99.0 if 2 <= i < 258 else pieces[i][1] for i in ids)
    wrong = sentencepiece_codec.verify_parity(data, texts)
    assert len(wrong) <= 2 and all(score(codec.encode([t])[0]) == pytest.approx(score(theirs.encode(t)), abs=1e-9) for t in wrong)  # ties
    assert any(2 <= i < 258 for ids in coded for i in ids)
    assert codec.decode(coded) == [" ".join(t.split(" ")).strip(" ").replace("  ", " ") for t in texts]
    assert codec.decode(coded) == theirs.decode(coded)


def budgets(tokens, exponent, target):
    p = {s: n / sum(tokens.values()) for s, n in tokens.items() if n}
    w = {s: v**exponent for s, v in p.items()}
    total = sum(w.values())
    times = {s: w[s] / p[s] / min(w[k] / p[k] for k in w) if target.keep_all else w[s] / total / p[s] * target.budget for s in p}
    return {s: v / total for s, v in w.items()}, times


@pytest.mark.parametrize("bits", [10, 2, 0])
@pytest.mark.parametrize("target", [mixing.Target(repetition=1.6), mixing.Target(entropy=1.2), mixing.Target(repetition=2.0, keep_all=True)])
def test_mixing(spark, monkeypatch, target, bits):
    monkeypatch.setattr(mixing, "SLICE_BITS", bits)
    rng = np.random.default_rng(6)
    rows = [(k, "t " * int(rng.integers(1, 60)), ["big"] * 6 + ["mid"] * 3 + ["low"]) for k in range(900)]
    rows = [(k, t, s[k % 10] if k % 50 else "rare") for k, t, s in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(docs, target).collect()
    size = {k: len(t.split()) for k, t, _ in rows}
    tokens, taken = {}, {}
    for k, _, s in rows:
        tokens[s] = tokens.get(s, 0) + size[k]
    for r in got:
        taken[r["source"]] = taken.get(r["source"], 0) + size[r["doc_id"]]
    measure = lambda a: budgets(tokens, a, target)
    low, high = 0.0, 1.0
    for _ in range(40):  # plain bisection
        mid = (low + high) / 2
        w, times = measure(mid)
        over = -sum(v * math.log(v) for v in w.values()) > target.entropy if target.entropy else max(times.values()) > target.repetition
        low, high = (mid, high) if over else (low, mid)
    _, times = measure(high)
    for s, n in tokens.items():
        assert abs(taken[s] - times[s] * n) <= max(size.values()) + 1
    each = {}
    for r in got:
        each.setdefault((r["source"], r["pass"]), []).append(r["doc_id"])
    assert all(len(v) == len(set(v)) for v in each.values())  # a pass takes a document once
    for s in tokens:
        passes = sorted(p for t, p in each if t == s)
        assert passes == list(range(len(passes))) and all(len(each[s, p]) == sum(x[2] == s for x in rows) for p in passes[:-1])
    if target.keep_all:
        assert {r["doc_id"] for r in got} == set(size)
    # a last pass is the start of its order: no document left out comes before one taken
    for s in tokens:
        last = max(p for t, p in each if t == s)
        placed = sorted((r["place"], r["doc_id"]) for r in got if r["source"] == s and r["pass"] == last)
        assert len(placed) == len(set(placed))


def test_mixing_of_odd_tables(spark):
    x = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s"), (2, None, None), (None, "", "t"), (3, "a", "t")], "doc_id long, text string, source string")
    got = mixing.mixed(x, mixing.Target(repetition=2.0, keep_all=True)).collect()
    assert sorted(str(r["doc_id"]) for r in got if r["pass"] == 0) == ["1", "1", "2", "3", "None"]
    assert mixing.mixed(x.limit(0), mixing.Target(repetition=2.0)).count() == 0
    clashing = x.select("*", F.lit(9).alias("pass"), F.lit("b").alias("BLOCK"), F.lit(1).alias("place"), F.lit("other words").alias("Text"), F.lit(0).alias("s"))
    made = mixing.mix(clashing, mixing.Target(repetition=2.0, keep_all=True))
    assert sorted(made.columns) == sorted(["doc_id", "text", "source", "Text", "s", "pass", "block", "place"])
    key = lambda rows: sorted((str(r["doc_id"]), r["pass"], r["block"], r["place"]) for r in rows)
    assert key(made.select("doc_id", "pass", "block", "place").collect()) == key(got)
    with pytest.raises(ValueError):
        mixing.fit_exponent(x, mixing.Target())


def model_family(words):
    """(family, its probability, probability of any license) by the weights, term by term."""
    classes, bias, weights, temperature = licenses.fitted()
    z = (bias + sum((weights[g] for g in licenses.ngrams_of(words) if g in weights), np.zeros(len(classes)))) / temperature
    p = np.exp(z - z.max())
    p /= p.sum()
    return (classes[int(p.argmax())] if p.max() >= licenses.LEAST_PROBABILITY else licenses.UNKNOWN), float(p.max()), 1 - float(p[classes.index(licenses.UNKNOWN)])


def license_rows(spark, texts):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, "Released under the GPL v3", "x")], "doc_id long, text string, family string")
    return {(r["doc_id"], r["paragraph"]): r for r in licenses.license_paragraphs(docs).collect()}


#: Notices and clauses, hand-written and not among the templates.
HELD_OUT = {
    "mit": ["You can use this code under the MIT license", "THE SOFTWARE IS PROVIDED AS IS WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED", "the above copyright notice and this permission notice shall be included in all copies"],
    "apache-2.0": ["Distributed under the terms of the Apache License 2.0", "This file is licensed to you under the Apache License, Version 2.0", "you may not use this file except in compliance with the License"],
    "gpl-3.0": ["This file is part of a library under the GNU GPL v3"],
    "gpl-2.0": ["available under the GNU General Public License v2.0 only"],
    "lgpl": ["It is free software under the GNU Lesser General Public License (LGPL) version 2.1"],
    "bsd": ["The code is published under a 3-clause BSD license", "Redistributions of source code must keep the above copyright notice and the following disclaimer", "the names of its contributors may not be used to endorse products"],
    "isc": ["Permission to use, copy, modify and distribute this software for any purpose is hereby granted"],
    "mpl-2.0": ["Licensed under the Mozilla Public License 2.0"],
    "cc-by-sa": ["Available under CC BY-SA 4.0"],
    "cc-by-nc": ["Content is licensed under a Creative Commons Attribution-NonCommercial 4.0 license"],
    "agpl-3.0": ["The AGPL version 3 applies: GNU Affero General Public License"],
    "cc0": ["This work is in the public domain under CC0"],
    "unlicense": ["unencumbered software in the public domain"],
    "proprietary": ["(c) 2021 ACME Inc. All rights reserved worldwide.", "Alle Rechte vorbehalten 2020"],
}
PLAIN = ["plain words of the text", "mit dem Zug nach Hause", "Her driver's license was found under the seat", "The copyright of the song was sold in 1990", "The software company moved to the city", "It was provided that the work should be done by May"]


def test_licenses(spark):
    texts = [t for own in licenses.TEMPLATES.values() for t in own] + licenses.OTHERS + PLAIN + ["The license of x\n\n  Released under the MIT License. \r\nAll rights reserved.", None, "", "word " * 50_000 + "\nAll rights reserved."]
    got = license_rows(spark, texts)
    want = {}
    for k, t in enumerate(texts):
        for n, paragraph in enumerate(licenses.paragraphs_of(t)):
            family, p, odds = model_family(licenses.words_of(paragraph))
            if odds >= licenses.LEAST_LICENSE:
                want[k, n] = family, p
    assert set(got) == set(want) | {(None, 0)}
    for key, (family, p) in want.items():
        assert got[key]["family"] == family and got[key]["probability"] == pytest.approx(p, abs=1e-5)
    label = [f for f, own in licenses.TEMPLATES.items() for _ in own]
    assert all(got[k, 0]["family"] == f and got[k, 0]["confirmed"] for k, f in enumerate(label))
    assert not any(len(label) <= k < len(label) + len(licenses.OTHERS) + len(PLAIN) and r["family"] != licenses.UNKNOWN for (k, _), r in got.items() if k is not None)
    last = len(texts) - 4
    assert got[last, 2]["family"] == "mit" and got[last, 3]["family"] == "proprietary" and got[last + 3, 1]["family"] == "proprietary"
    assert licenses.license_paragraphs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_held_out_notices(spark):
    got = license_rows(spark, [t for own in HELD_OUT.values() for t in own])
    want = [f for f, own in HELD_OUT.items() for _ in own]
    found = [got[k, 0]["family"] if (k, 0) in got else licenses.UNKNOWN for k in range(len(want))]
    assert all(a in (b, licenses.UNKNOWN) for a, b in zip(found, want))  # no wrong family
    assert sum(map(str.__eq__, found, want)) >= 0.8 * len(want)


def test_wrapped_notices(spark):
    notice = "// Permission is hereby granted, free of charge, to any person\n// obtaining a copy of this software and associated documentation\n// files, to deal in the Software without restriction."
    text = f"Some words\n\n{notice}\nNext paragraph of the text\n"
    assert len(licenses.paragraphs_of(text)) == 5
    got = license_rows(spark, [text])
    assert got[0, 2]["family"] == "mit" and got[0, 2]["confirmed"] and [k for k in got if k[0] == 0] == [(0, 2)]


def test_evidence_loses_no_row():
    rng = np.random.default_rng(4)
    _, _, weights, _ = licenses.fitted()
    vocabulary = sorted({w for g in weights for w in g.split()})
    notices = [licenses.words_of(t) for own in licenses.TEMPLATES.values() for t in own]
    passed = 0
    for k in range(1500):
        words = list(rng.choice(vocabulary, rng.integers(1, 25))) if k % 3 else notices[rng.integers(len(notices))][: rng.integers(2, 12)]
        own = licenses.may_be_license(words)
        passed += own
        assert own or model_family(words)[2] < licenses.LEAST_LICENSE
    assert 0 < passed < 1500
    assert not licenses.may_be_license(licenses.words_of(PLAIN[0]))


def test_pipeline(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = common.checkpoint(stage(spark, docs, sf_dir))
        seen[name] = (docs, out)
        docs = out
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
    ids = lambda d: [r[0] for r in d.select("doc_id").collect()]
    before, after = seen["language identification"]
    want = {r["doc_id"] for r in language.identify_languages(before).where("lang_pred <> 'und' and score >= 0.5").collect()}
    lettered = {r["doc_id"] for r in before.collect() if r["text"] and any(map(str.isalpha, r["text"]))}
    assert set(ids(after)) == want <= lettered and len(want) >= 0.99 * len(lettered)
    before, after = seen["toxicity"]
    (labels,) = tables(spark, sf_dir, "labels")
    assert set(ids(after)) == {r["doc_id"] for r in toxicity.toxicity_scores(before, labels).where("predicted = 0").collect()}
    before, after = seen["simhash near-dedup"]
    assert len(ids(after)) == len(set(ids(after))) < len(ids(before))
    before, after = seen["source mixing"]
    assert set(ids(before)) == set(ids(after))
    _, last = seen["sentencepiece encoding"]
    assert last.where("not round_trip").count() == 0 and last.where("n_tokens = 0").count() == 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_language_stage_keeps_what_is_wanted(spark, sf_dir, monkeypatch):
    docs = common.table(spark, sf_dir, "documents")
    predicted = {r["doc_id"]: r for r in language.identify_languages(docs).collect()}
    monkeypatch.setattr(corpus_pipeline, "LANGUAGES", ("en", "xx"))
    monkeypatch.setattr(corpus_pipeline, "LEAST_SCORE", 0.9)
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, sf_dir).collect()}
    assert kept == {i for i, r in predicted.items() if r["lang_pred"] == "en" and r["score"] >= 0.9} and 0 < len(kept) < len(predicted)


def test_stages_take_odd_tables(spark, sf_dir):
    docs = odd(spark).withColumn("n_chars", F.lit(1).cast("long"))
    texts = lambda d: sorted((r["text"] or "") for r in d.collect())
    own = sorted((t or "") for _, t in ODD)
    want = {  # of rows without an id all stay; equal texts with ids are one
        "language identification": sorted(t for _, t in ODD if t and any(map(str.isalpha, t))), "toxicity": own,
        "simhash near-dedup": sorted(["", "42 !?", "a b", "Word und " * 20_000, ""]), "source mixing": own, "sentencepiece encoding": own,
    }
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert texts(out) == want[name], name
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_language_stage_without_languages(spark, sf_dir):
    docs = odd(spark).withColumn("lang", F.lit(None).cast("string"))
    out = corpus_pipeline.identify_language(spark, docs, sf_dir)
    assert out.columns == docs.columns and sorted(r["text"] for r in out.collect()) == sorted(t for _, t in ODD if t and any(map(str.isalpha, t)))


def test_all_queries_are_registered():
    assert [q.split("_")[0] for q in queries.queries()] == [f"op{k}" for k in range(1, 11)]
