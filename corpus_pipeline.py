"""The corpus pipeline: documents in, mixed and tokenised training documents out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of docs. ORACLE_SQL is None: the stages learn models
and hash, which SQL cannot express; tests hold them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import language, mixing, sentencepiece_codec, simhash_dedup, toxicity
from skein.llm.common import checkpoint, table

ORACLE_SQL = None

#: Languages that stay, None for all that can be learned, and the least score of the predicted one.
LANGUAGES, LEAST_SCORE = None, 0.5
#: Sources are evened out as far as no document is taken over twice and each once.
MIX = mixing.Target(repetition=2.0, keep_all=True)


def _where(docs: DataFrame, value: str, made, keep) -> DataFrame:
    """The rows of docs, all columns, for which keep holds of made(text, named `value`)."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    scored = plain.withColumn(value, made(F.col(f"c{names.index('text')}")))
    return scored.where(keep(F.col(value))).drop(value).toDF(*names)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted language is one of LANGUAGES with a score of LEAST_SCORE or more.

    Texts that are null or have no letter are in no language and go. Where no
    language can be learned, all others stay. Whole texts are read, whatever their length; null ids
    and repeated rows are judged like others; an empty table gives an empty one; columns of any name stay.
    """
    net = language.train(language.sample(docs))
    if not net.langs:  # nothing to learn from: all that has a letter stays
        return _where(docs, "letter", lambda text: text.rlike(r"\p{L}"), lambda letter: letter)
    identify = language.identifier(spark, net)
    wanted = sorted(net.langs if LANGUAGES is None else set(net.langs) & set(LANGUAGES))
    return _where(docs, "r", identify, lambda r: r["lang_pred"].isin(wanted) & (r["score"] >= LEAST_SCORE))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on this stage's labelled ones, scores below one half.

    Null texts score as empty ones, by the share of toxic labels alone; a score of one half goes. Without
    labels that share counts as a tenth, and all stay. Whole texts are read; null ids and repeated rows are judged like
    others; an empty table gives an empty one; columns of any name stay.
    """
    score = toxicity.scorer(spark, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return _where(docs, "score", score, lambda s: s < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, likeness of 0.8 or more):
    candidates from the SimHash index and, as that alone misses most links, from min-hash bands.

    Most of the links are found by the bands, not by SimHash. Null texts count as empty and empty ones are
    equal; of repeated rows one stays; of a group the smallest id stays; rows without an id all stay.
    Whole texts are compared; an empty table gives an empty one; columns of any name stay.
    """
    return simhash_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, dealt and sorted in the order of its passes.

    Null sources are one source; null and empty texts have no words, and a source of only those is
    taken once; repeated rows are documents of their own; very long texts are counted whole; an empty table gives
    an empty one; columns of any name stay.
    """
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    mixed = mixing.mix(plain, MIX, *(f"c{names.index(n)}" for n in ("doc_id", "text", "source")))
    dealt = mixed.repartition(mixing.PASS, "block").sortWithinPartitions(mixing.PASS, mixing.ORDER)
    return dealt.select(*plain.columns).toDF(*names)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids.

    Null and empty texts have none; whole texts are encoded; repeated rows stay; an empty table gives an
    empty one; columns of any name stay but those that the encoding makes, which are replaced.
    """
    return sentencepiece_codec.encode_documents(docs)


STAGES = [
    ("language identification", identify_language),
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("source mixing", mix_sources),
    ("sentencepiece encoding", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; each stage's rows are checkpointed for the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
