"""Training corpus from raw documents: five stages, each written as Parquet and read back as the next one's input.

All stages but the last return rows of `docs` with all its columns, whatever their names: extra ones, also such with dots
or with names that an operator uses, pass through. Rows are judged one by one, so a null or repeated doc_id never makes one
row share another's fate, except where texts are copies. An empty table gives an empty result in every stage. Texts are
processed whole, of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from canopy.llm import decontaminate, linededup, minhash, packing, toxicity
from canopy.llm.common import drop_table, materialize, read_table

#: Jaccard similarity of word shingles from which documents are near duplicates, in percent.
NEAR = 80


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier chain does not reject.

    Null and empty texts have no words and stay; equal texts, repeated rows among them, share their fate; without labels
    nothing is rejected.
    """
    return toxicity.keep_clean(docs, read_table(spark, sf_dir, "labels"))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the runs of lines that an earlier one has; n_chars follows the text.

    Null and empty texts stay as they are. Order is by doc_id (null first), then by text. Rows equal in doc_id and text are
    treated alike. A text that is wholly a repetition becomes empty, and its row stays.
    """
    return linededup.remove_repeats(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates: the one with the smallest doc_id, null ids last.

    Of rows repeated as they are, one stays. Texts without words, null and empty ones, are no copies of each other, and all
    of them stay.
    """
    return minhash.keep_one(docs, percent=NEAR)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, null and empty texts among them; an empty benchmark drops nothing."""
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining rows' pieces, each with its place in a training sequence.

    Null and empty texts are one closing token; repeated rows are packed each; other columns are left out.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", cut_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_copies),
    ("packing", pack_sequences),
]

#: Linear models, alignment and tokenization have no SQL form: tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        if before is not None:
            drop_table(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
