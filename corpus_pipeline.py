"""A corpus pipeline: quality rules, line dedup, near-duplicate removal, PII, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read
again as the next one's docs.  All but the last return the columns of ``documents``.  An empty table
gives an empty one; other columns of ``docs`` are not passed on; a document is never cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratecraft.llm import line_dedup, ngram_join, packing, pii, quality_rules
from ratecraft.llm.components import Scratch
from ratecraft.llm.queries import PII_KEY, table, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it is now."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null, empty and short texts fail the base rules and go; repeated rows are judged alike.  The chain is
    trained on all of documents and labels of ``sf_dir``, whatever ``docs`` holds.
    """
    crf = quality_rules.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return _documents(quality_rules.quality(docs, crf).where("kept"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the repeats of lines that many sites share.

    Null texts stay null; a text can become empty.  Of a line's occurrences that of the least id and place stays, a null id
    before all others; rows equal in id and text count as one.
    """
    return _documents(line_dedup.dedup_lines(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near copies.

    Rows that share an id are one document: they stay or go together.  Null, empty and wordless texts are near to nothing and
    stay, and so do rows without an id, which are the document of no group.
    """
    found = ngram_join.near_duplicates(docs, k=5, percent=80)
    gone = found.where("doc_id != component_id").select("doc_id").distinct()
    return _documents(docs.join(gone, "doc_id", "left_anti"))


def hide_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data, one for each entity wherever it occurs.

    Null and empty texts stay as they are.  Surrogates are checked to be distinct over all documents.
    """
    return _documents(pii.replace_checked(docs, PII_KEY))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens.

    A null or empty text is its end token alone; repeated rows and rows without an id are packed each.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", drop_lines),
    ("near duplicates", drop_near_copies),
    ("pii", hide_pii),
    ("packing", pack_documents),
]

#: SQL can't express the trained stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each over all that its predecessor kept."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
