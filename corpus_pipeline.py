"""A training-data pipeline over `documents`: five stages, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import bpe, exact_dedup, mixing, quality, simhash
from corpusflow.llm.common import Scratch, key_filter, with_maybe


#: The columns of documents that stages read or change.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _whole_rows(stage: Callable) -> Callable:
    """A stage that gives back all columns that it got: those it doesn't know lie in one struct meanwhile, so that no name of theirs meets
    one that is used inside."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        more = [c for c in docs.columns if c not in OWN]
        if not more:
            return stage(spark, docs, sf_dir)
        quoted = lambda c: "`" + c.replace("`", "``") + "`"
        out = stage(spark, docs.select(*[c for c in docs.columns if c in OWN], F.struct(*map(quoted, more)).alias("_more")), sf_dir)
        return out.select(*[F.col(c) if c in OWN else F.col("_more")[c].alias(c) for c in docs.columns])

    return run


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a number for each row, written: numbers given anew by each scan would change with how files are split."""
    return Scratch(docs.sparkSession, "numbered").save(docs.withColumn("_row", F.monotonically_increasing_id()), "zstd")


def _rows(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of docs that stay. Those that a filter of bounded size can't rule out of the dropped ones are joined; others don't move."""
    gone = Scratch(docs.sparkSession, "dropped").save(decided.where("not kept").select("_row"))
    seen = with_maybe(docs, F.xxhash64("_row"), key_filter(gone.select(F.xxhash64("_row").alias("h"))), "_maybe")
    some = seen.where("_maybe").join(gone, "_row", "left_anti")
    return seen.where("not _maybe").unionByName(some).drop("_row", "_maybe")


@_whole_rows
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the convolutional network rejects (score under 0.7) go."""
    return quality.accepted(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@_whole_rows
def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    docs = _numbered(docs)
    return _rows(docs, exact_dedup.exact_dedup(docs, row_col="_row"))


@_whole_rows
def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at a similarity of 0.8 or more by shingles of five words the one with the smallest doc_id stays."""
    docs = _numbered(docs)
    return _rows(docs, simhash.near_dedup(docs, "_row", order=["doc_id"]))


@_whole_rows
def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target says, the last time perhaps in part."""
    docs = _numbered(docs)
    return mixing.repeat(docs, mixing.mix(docs, row_col="_row"), "_row", chars_col="n_chars" if "n_chars" in docs.columns else None).drop("_row")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each row, and digests of them and of what they decode to."""
    import public_tokenizers

    out = bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", simhash_stage),
    ("mixing", mix_stage),
    ("BPE", bpe_stage),
]

#: A network's scores and 64-bit hashes are not SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of what the stages keep; null texts count as empty, null sources as one source, an empty table gives none."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
