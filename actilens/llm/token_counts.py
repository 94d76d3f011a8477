"""Token counts through a digest cache.

A cache is a Parquet table (content, tokenizer, n_tokens) in a folder that outlives the job: the SHA-256 of a text's
UTF-8 bytes, the SHA-256 of the tokenizer file, and the count. Counting joins the digests of all documents to the cache,
encodes each content that is not there once, appends the new counts and joins again. Counts depend on every byte, so the
normalised content is the text itself, with null as the empty text.

Defined cases: null text is empty and has 0 tokens; repeated texts are encoded once; null and repeated ids keep their
rows; entries of other tokenizers are left alone, and entries that two jobs appended at the same time count once; a cache
folder that does not exist is empty; an empty table appends nothing; only the id and text columns are looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actilens.llm.common import partitions, steps, work_path
from actilens.llm.token_files import ENCODE_BYTES, public_tokenizer
from actilens.llm.tokenizing import piece_counts

LIMIT = 4096
ENTRY = "content binary, tokenizer string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def cached(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """``content``, ``n_tokens`` of one tokenizer; no rows where no cache has been written."""
    try:
        entries = spark.read.schema(ENTRY).parquet(cache)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        entries = spark.createDataFrame([], ENTRY)
    return entries.where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def _first_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each content in this task, so a content with very many copies moves as one row a task."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for content in batch.column("content").to_pylist():
            keep.append(content not in seen)
            seen.add(content)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, seen = piece_counts(path), set()
        for batch in steps(batches, limit=ENCODE_BYTES):
            fresh = []
            for content in batch.column("content").to_pylist():
                fresh.append(content not in seen)
                seen.add(content)
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(counter.counts(batch.column("text")))], ["content", "n_tokens"])

    return run


def _digested(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("content"), text.alias("text"))


def update(docs: DataFrame, cache: str, tokenizer: str) -> None:
    """Append the counts of all contents of ``docs`` that the cache does not have."""
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer)
    rows = _digested(docs).select("content", "text")
    single = rows.mapInArrow(_first_of_task, rows.schema)
    known = cached(spark, cache, version)
    misses = single.join(known.select("content"), "content", "left_anti").repartition(partitions(spark), "content")
    counts = misses.mapInArrow(_counted(tokenizer), "content binary, n_tokens long")
    counts.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)


def counts(docs: DataFrame, cache: str, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` of every row, misses encoded and appended first."""
    update(docs, cache, tokenizer)
    rows = _digested(docs).select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes"))
    found = rows.join(cached(docs.sparkSession, cache, tokenizer_digest(tokenizer)), "content")
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def counted_rows(docs: DataFrame, tokenizer: str = "piece_bpe_32k.model") -> DataFrame:
    """The rows of query op7, with a cache of its own that begins empty."""
    return counts(docs, work_path(docs.sparkSession, "token-counts"), public_tokenizer(tokenizer))
