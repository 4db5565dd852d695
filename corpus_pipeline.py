"""Corpus pipeline: toxicity, near duplicates, repeated strings, benchmark leaks, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table; all but the
last return the columns of ``documents``.  Between stages the table is written
to shared storage as Parquet and read again.

Defined cases, of every stage: a null text is empty text; an empty table gives
an empty table; other columns, whatever their names, pass through unchanged;
texts are taken whole, however long; rows without an id are handled like any
other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm import decontaminate, minmax, packing, suffix_dedup, toxicity
from loamgrid.llm.common import stored

#: Texts with this probability of being toxic, or more, are rejected.
REJECT = 0.5
#: Repeated strings of at least so many bytes are cut.  Ordinary prose takes more for 50 words; a shorter
#: repeat of over 50 words, as a run of one- and two-letter words ("it it it"), is left in the texts.
REPEAT_BYTES = 220


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject.

    Null and empty texts get the score of the model's bias, so they stay
    unless most text is toxic; without toxic labels every row stays; equal
    texts stay or go together.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scores(docs, model, below=REJECT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one of least id.

    Texts without words are like no other and stay, null ones included; rows
    without an id go only if their class has a row with one; of rows equal in
    id and text one stays; of several texts with one id each is its own row.
    """
    return minmax.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings that an earlier text, or an earlier place, holds too.

    All rows stay: a text that is cut whole becomes empty, a null one stays
    null; ``n_chars`` follows the text.  Earlier means a smaller id (null
    first), then the hash of the text.
    """
    out = suffix_dedup.cut_repeats(docs, length=REPEAT_BYTES, keep="first")
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any 13-word passage of the benchmark, or whole shorter item.

    Texts without words stay; items without words, or an empty benchmark,
    remove nothing.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), percent=0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, as pieces with their ids.

    A null or empty text is its end token; rows with repeated or null ids are
    packed like any other.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, length=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can't express the trained model and the tokenizer; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
