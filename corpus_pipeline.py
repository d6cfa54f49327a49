"""A training corpus from raw documents: five stages, each written and read again.

Part of the subpackage ``llm``: it goes with it.

The input needs the columns doc_id, text, lang and source, all of which may be null; other columns
travel along up to the last stage. Cases: documents with null, empty or blank text fail the quality rules and
go there, as do those whose every line is a later copy in line dedup. A null lang teaches no
reference. Of equal rows near dedup keeps one; a null doc_id counts as later than all others, and a null source
is a source of its own. An empty table gives no piece. Mixing orders the rows by slot and hands on
its weights; packing seeds its windows and takes the sequences of a source in the order in which
mixing wrote the rows, and follows a schedule of its weights in tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boardloom.llm._common import staged
from boardloom.llm.line_dedup import drop_repeated_lines
from boardloom.llm.minhash_dedup import keep_representatives
from boardloom.llm.mixing import mixed
from boardloom.llm.packing import pack
from boardloom.llm.quality_rules import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_representatives(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, source_col="source")


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: SQL can express neither the sketches nor the packing; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
