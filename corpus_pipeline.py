"""Corpus pipeline: language ID, exact dedup, near dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of `documents`. Rows are matched by doc_id, which is the key of
`documents`; a row whose doc_id is null is kept by the deduplicating and
decontaminating stages, as nothing can be decided about it by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import functions as F

from pulseloom.llm.common import stage, table
from pulseloom.llm.containment import contained
from pulseloom.llm.dart_minhash import near_duplicates
from pulseloom.llm.exact_dedup import exact_groups
from pulseloom.llm.language_id import predict
from pulseloom.llm.packing import default_tokenizer, pack

#: Bits that a byte may cost under its language's automaton: as much as one of 32 letters drawn at random.
MAX_BITS = 5.0
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the prediction accepts: of a learned language, at no more than MAX_BITS a byte.

    Texts that no automaton parses in long phrases (other scripts and languages, keys, noise) are rejected, and those without
    a letter (`und`; null and empty texts too). `lang` stays as it was, and is not compared. Ids play no part: rows with null
    or repeated ids are judged each. An empty table stays empty; other columns than those of `documents` go.
    """
    judged = predict(docs, docs, COLUMNS)
    return judged.where((F.col("lang_pred") != "und") & (F.col("bits") <= MAX_BITS)).select(*COLUMNS)


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space the smallest id stays (null and empty texts are equal)."""
    return _without(docs, exact_groups(docs).where("NOT kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays; texts without a word are in no class."""
    return _without(docs, near_duplicates(docs).where("NOT kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item."""
    return _without(docs, contained(docs, table(spark, sf_dir, "benchmark")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens; a null text is its end token alone, repeated rows are packed each."""
    return pack(docs, default_tokenizer())


STAGES = [("language", language), ("exact", exact), ("near", near), ("decontaminate", decontaminate), ("packing", packing)]
#: SQL has no suffix automata, signatures or tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
