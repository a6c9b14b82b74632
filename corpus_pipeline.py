"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of docs, with n_chars of the text that is left. Rows are told apart by all that a stage reads, not by their id:
rows without an id and rows that repeat one are documents of their own. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplekit.llm import decontamination, line_dedup, packing, quality_rules, simhash
from samplekit.llm.common import keyed_rows, materialize, table
from samplekit.llm.registry import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _sized(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of `like`, n_chars as the text now has it."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(like.schema["n_chars"].dataType))
    return docs.select(*like.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Null and empty texts have too few words and go; repeated rows, those without an id and ties stay or go together."""
    own = keyed_rows(docs)
    lean = own.select("r1", "r2", *(F.col(f"row.{c}").alias(c) for c in ("doc_id", "text", "lang", "source")))
    kept = quality_rules.judge_quality(lean, "r1", "r2").where("kept").select("r1", "r2")
    return own.join(kept, ["r1", "r2"], "left_semi").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without boilerplate lines. Null texts stay null; every row stays, also one that is left empty, repeated rows and those without an id."""
    return _sized(line_dedup.without_boilerplate(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that share 0.8 of their five-word shingles, the document with the smallest id; one without an id only where none has one. Rows alike in all columns are one."""
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated, each row a document of its own; what benchmark passages they have all the same is cut out. A null text stays null."""
    return _sized(decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with their place in a sequence. A null or empty text gives one piece, its end alone; every row gives its pieces, also one without an id."""
    return packing.op2_best_fit_packing(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("best_fit_packing", pack),
]

#: SQL has no XXH64 and no tokenizer; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
