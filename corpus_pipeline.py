"""The corpus pipeline: five stages over ``documents``, each calling one operator.

Each stage works on all that the one before kept. ``run`` applies them one after the other.

Stages decide on rows, not on keys, so repeated and null doc_ids are told apart: a row is named by
the file that it stands in and its place there. A stage gathers the names of the rows that go; the
texts of the others never move. A table without rows passes every stage; a null text is empty, null labels and
sources are as the operators have them, and columns beside those of ``documents``, whatever their names, come through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from glacis.llm import langid
from glacis.llm.common import bitmap, discard, held, scratch, stored
from glacis.llm.exact_dedup import exact_dedup
from glacis.llm.jaccard import jaccard_components
from glacis.llm.packing import pack_documents
from glacis.llm.queries import tokenizer
from glacis.llm.toxicity import fit, toxicity


def _named(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a column that names each row by file and place, and that column's name.

    Rows that don't come from files are written first.
    """
    name = "_row"
    while name in docs.columns:
        name += "_"

    def named(rows: DataFrame) -> DataFrame:
        at = rows.metadataColumn("_metadata")
        return rows.withColumn(name, F.struct(F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("place")))

    try:
        return named(docs), name
    except AnalysisException:
        return named(stored(docs, "rows")), name


def _without(rows: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """``rows`` without those that ``gone`` names, and without their names.

    A bit map of bounded size tells on the spot that a row isn't named; only rows that it can't tell are
    exchanged to meet ``gone``.
    """
    gone = stored(gone.select(F.col(row)), "gone")
    bits, width = bitmap(gone.select(F.xxhash64(row).alias("key")))
    if not bits.any():
        return rows.drop(row)
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def perhaps(key: pd.Series) -> pd.Series:
        return pd.Series(held(shared.value, width, key.to_numpy(np.int64).view(np.uint64)))

    told = perhaps(F.xxhash64(row))
    return rows.where(~told).union(rows.where(told).join(gone, row, "left_anti").select(*rows.columns)).drop(row)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without any letter or digit (null and empty ones too) and those without a likely language.

    A null label teaches nothing; a null source is a source of its own. Without any label all
    languages are one. Repeated rows are decided alike.
    """
    rows, row = _named(docs)
    found = langid.text_languages(rows, langid.fit(docs), key=row)
    return _without(rows, row, found.where(~F.col("accepted")))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic; learns from the labels of those that came this far.

    Null and empty texts score as a text without evidence does; without labels of both kinds nothing goes.
    Repeated rows score alike.
    """
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows, row = _named(docs)
    return _without(rows, row, toxicity(rows, model, key=row).where("predicted = 1"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts, the one with the largest doc_id (null ones last, then by the
    place of the row). Null and empty texts are one group."""
    rows, row = _named(docs)
    ranked = rows.select("text", F.struct("doc_id", row).alias("key"))
    return _without(rows, row, exact_dedup(ranked, key="key").where("not kept").select(F.col(f"key.{row}")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group linked by a Jaccard similarity of 0.8 or more on five-word shingles, the one with
    the smallest doc_id (null ones last, then by the place of the row). Texts without words are linked with nothing and stay."""
    rows, row = _named(docs)
    ranked = rows.select("text", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row).alias("key"))
    found = jaccard_components(ranked, key="key", words=5, percent=80)
    return _without(rows, row, found.where("key <> component_id").select(F.col(f"key.{row}")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens: one row a piece. A null text is empty: one piece, its final 0."""
    return pack_documents(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("language_id", language), ("toxicity", toxic), ("exact_dedup", exact), ("ngram_jaccard", near), ("best_fit_packing", packing)]

#: SQL can't express the trained classifiers and the packing; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again, as on a cluster, and
    deleted as soon as the next stage's are written, with all that the stage had stored."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch(spark) as keep:
            keep(done := stored(stage(spark, docs, sf_dir), name))
        if last is not None:
            discard(last)
        docs = last = done
    return docs
