"""Five stages from raw documents to packed training sequences.

Each stage calls one operator of ``corpusloom.llm`` and works on all that the
stage before kept; between stages the documents are written as Parquet and read
again.  All stages but the last return the columns of ``documents``.

Defined results, stage by stage:

* quality rules: null and empty texts fail and go; rows equal in ``doc_id`` and
  text share their verdict; a row without an id is judged like any other; texts
  of any length are judged whole;
* line dedup: lines of rows without an id are neither counted nor dropped; a null
  text stays null; of equal keys the smallest id keeps its lines; a text may
  become empty and stays as a row;
* near-duplicates: of each group the smallest id stays, with all rows of that id;
  rows without an id, and texts without words, stay;
* passage dedup: rows without an id are neither compared nor changed; equal rows
  are one place; a text of which all is repeated becomes empty;
* packing: one row a piece; null and empty texts are the end id alone.

Empty tables give no rows at every stage.  Other columns pass through all stages
but the last untouched, whatever their names; ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import created, discard, saved, table
from corpusloom.llm.op2_minhash import near_duplicates
from corpusloom.llm.op4_suffix import remove_repeats
from corpusloom.llm.op5_quality import quality_rules
from corpusloom.llm.op6_lines import dedup_lines, line_index
from corpusloom.llm.op10_pack import pack_pieces, pieces

#: Words in a shingle of the near-duplicate stage: stages without a contract of their own
#: take five, where the query of operator 2 takes four by its contract.
SHINGLE_WORDS = 5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the base rules and the n-gram log-likelihood ratio."""
    kept = quality_rules(docs, table(spark, sf_dir, "labels")).where("kept")
    # Rows are told apart by id and text, so equal rows share their verdict.
    kept = kept.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct()
    same = docs["doc_id"].eqNullSafe(kept["_doc"]) & (F.xxhash64(docs["text"]) == kept["_hash"])
    return docs.join(kept, same, "left_semi")


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, where it is there, as the cleaned text has it."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that an earlier document holds."""
    return _counted(dedup_lines(docs, line_index(docs)))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each near-duplicate group."""
    gone = near_duplicates(docs, words=SHINGLE_WORDS).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 100 bytes and more that an earlier place holds."""
    return _counted(remove_repeats(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token pieces of the remaining documents into sequences."""
    return pack_pieces(saved(pieces(docs), "op10-pieces"))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("suffix_dedup", passage_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL has no tokenizer, sketch or suffix array; tests/llm compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, mark = docs, len(created)
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
        # Nothing reads the stage's own tables and files any more.
        discard(before, *[x for x in created[mark:] if x != docs._saved_at])
    return STAGES[-1][1](spark, docs, sf_dir)
