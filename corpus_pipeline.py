"""From raw documents to packed sequences, in five stages, each one operator over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each one's
rows to the shared folder and reads them again as the next one's docs. All but the last
return the columns of documents, whatever further ones those have and however they are called.
Without documents every stage gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import common, lines, longprints, packing, quality, substrings
from quernstone.llm.tokens import public_tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host isn't rejected. A null text fails; a null source is no host; a null doc_id and repeated rows stay as they are."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that a document before has. A null doc_id is before none and after all; null texts stay null."""
    return lines.drop_repeated_lines(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: a Jaccard similarity of 0.8 or more on five-word shingles. The least doc_id stays, a null one only if there is no other; equal rows are one; null and empty texts are one group."""
    return longprints.drop_similar(docs, words=5)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 200 bytes that start elsewhere as well, in repeated rows too. Null texts stay null."""
    return substrings.drop_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens. A null text is empty; a null doc_id stays null."""
    return packing.pack_documents(docs, public_tokenizer("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("simhash_dedup", simhash_dedup), ("suffix_dedup", suffix_dedup), ("packing", pack)]

#: SQL has no fingerprints, suffix arrays or tokenizers; tests compare run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), common.written()
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        common.clean(spark, keep=docs, before=before)
    return docs
