"""A training-corpus pipeline: language, exact copies, near copies, source mix, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result as Parquet to the
shared folder and reads it again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.llm import bagminhash, exact_dedup, mixing, packing, ppm_langid
from weft.llm.common import bounded_batches, table, written
from weft.llm.queries import language_model, tokenizer_path

#: The columns of documents, which every stage but the last returns.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; undetermined and ambiguous ones go.

    Null, empty and letterless texts are undetermined and go; null languages, sources and ids are no inputs of the
    decision, and rows that repeat are judged each. An empty table gives an empty table.
    """
    bounded_batches(spark)
    return ppm_langid.accepted_documents(docs.select(*COLUMNS), language_model(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (equal up to white space): the smallest id, null ids last.

    Null and empty texts are one group. A row that repeats id and text goes; a row that repeats an id with another text
    is judged by its own text. An empty table gives an empty table.
    """
    return exact_dedup.keep_first_copies(docs.select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the smallest id, null ids last.

    Texts without words are classes of their own and stay. Rows are told apart by id and text, so that an id that comes
    twice loses no text of its own. An empty table gives an empty table.
    """
    bounded_batches(spark)
    return bagminhash.keep_one_of_each(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to target weights, a row for each copy taken.

    A null source is a source, null texts have size 0 and, like all texts without words, are not taken; rows that repeat
    are taken alike. An empty table gives an empty table.
    """
    return mixing.mixed_documents(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences. Null and empty texts are their end token; rows that repeat are packed each; an empty
    table gives an empty result."""
    bounded_batches(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language models, signatures and tokens have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
