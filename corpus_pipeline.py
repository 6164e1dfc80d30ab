"""A corpus pipeline of five operators: language, near copies, repeated passages, source weights, token ids.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of documents. run()
writes each stage's rows to the shared folder and reads them again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import bpe, language, mixing, simhash, substrings
from gleanery.llm.queries import TOKENIZER
from gleanery.session import materialise, prepare, release_new, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL can't express the mixture model, the covering tables, the permutations or the tokenizer.
ORACLE_SQL = None


def prepared(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of documents, in a session made ready for the operators."""
    prepare(spark)
    return docs.select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told, with lang set to it; null texts, texts without letters and unclear ones go.

    Equal texts get equal answers, repeated rows each stay or go; an empty table gives an empty result.
    """
    docs = prepared(spark, docs)
    return language.keep_identified(docs, language.learn(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents alike by five-word shingles (similarity 0.8 or more) only that of the least doc_id stays.

    Null doc_ids come last; rows of one doc_id are judged each by its own text; of wholly equal rows one stays. Null and
    wordless texts are copies of each other; an empty table gives an empty result.
    """
    return simhash.keep_one(prepared(spark, docs))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of 20 words or more that stand earlier in the corpus are cut out of the texts.

    Every row stays, if need be with an empty text; a null text stays null. Null doc_ids come last; rows equal in doc_id
    and text count as one document and are cut alike; an empty table gives an empty result.
    """
    return substrings.without_repeats(prepared(spark, docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources by target weight: a row for each document, output shard and turn that takes words of it.

    A null source is one more source; null and wordless texts give nothing; repeated rows each count; an empty table
    gives an empty result.
    """
    mixed = mixing.mix_documents(prepared(spark, docs))
    return mixed.withColumn("n_chars", F.length("text").cast("long"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with doc_id and source: a row for each row; a null text has none."""
    return bpe.encode_beside(prepared(spark, docs).select("doc_id", "source", "text"), TOKENIZER)


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("mix", mix_sources),
    ("tokens", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    before = written()
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        release_new(spark, before, docs)  # what the stages so far have read is needed no more
    return STAGES[-1][1](spark, docs, sf_dir)
