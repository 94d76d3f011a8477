"""Target-distribution importance resampling: documents drawn by how much their features look like a target's.

A feature is a run of 1 to ``RUN`` consecutive words; its bucket is a CRC-32 modulo ``BUCKETS``. Counts of all documents and
of the target give each bucket a gain, the logarithm of its ratio; a document weighs the mean gain of its features, looked
up in the array of gains. Gumbel noise from a hash of the id makes the highest scores a draw without replacement.

The cutoff of the draw is found without sorting the table: a quantile sketch brackets it, exact counts outside the bracket
say whether it lies inside (else the bracket is widened), and only the rows of the bracket are sorted. Drawn rows are ranked
in range partitions, numbered inside each and moved by the counts of those before.

Defined cases: null text has no words and weighs 0; a null id is hashed as the empty text and comes after all others in a
tie; rows that repeat an id are documents of their own, in the order in which they were stored; a very long text is worked
on in slices of about ``SLICE_BYTES``, cut between words; an empty table gives an empty result, an empty target counts no
features; other columns of the input are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actilens.llm.common import partitions, steps, stored

BUCKETS = 10_000
#: Bytes of one text whose words are Python objects at the same time.
SLICE_BYTES = 1 << 20
#: Relative rank error of the quantile sketch, and the first half width of the bracket in ranks.
ACCURACY, HALF_WIDTH = 10_000, 0.0005
SEED, PERCENT, LEAST_WORDS = 7, 25, 20
SCORED = "doc_id long, n_words long, n_features long, weight long"


def _word_bytes() -> bytes:
    """Digits, letters (in lower case) and all bytes beyond ASCII stay; the rest is a blank."""
    kept = {b: b for b in (*range(48, 58), *range(97, 123), *range(128, 256))} | {b: b + 32 for b in range(65, 91)}
    return bytes(kept.get(b, 32) for b in range(256))


def _crc_table() -> np.ndarray:
    """CRC-32 of one more byte, for the byte that is shifted out."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


WORD_BYTES, CRC_TABLE = _word_bytes(), _crc_table()


def _with_blank(crcs: np.ndarray) -> np.ndarray:
    """The checksums of the same bytes and one blank behind them."""
    state = ~crcs
    return ~(CRC_TABLE[(state ^ 32) & 255] ^ (state >> 8))


def _slices(raw: bytes) -> Iterator[bytes]:
    """The text in slices that end between words."""
    at = 0
    while len(raw) - at > SLICE_BYTES:
        end = raw.find(b" ", at + SLICE_BYTES)
        if end < 0:
            break
        yield raw[at:end]
        at = end
    yield raw[at:]


def text_buckets(text: str | None, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, int]]:
    """Buckets of the features of a text and the number of words, slice by slice."""
    last: np.ndarray | None = None
    for part in _slices((text or "").encode().translate(WORD_BYTES)):
        words = part.split()
        if not words:
            continue
        ones = np.fromiter(map(crc32, words), np.uint32, len(words))
        before = _with_blank(ones if last is None else np.concatenate([last, ones]))
        follow = words[1:] if last is None else words
        twos = np.fromiter(map(crc32, follow, before.tolist()), np.uint32, len(follow))
        last = ones[-1:]
        yield np.concatenate([ones, twos]) % np.uint32(buckets), len(words)


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts lie in each bucket: counted in every task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in steps(batches):
            for text in batch.column("text").to_pylist():
                for found, _ in text_buckets(text, buckets):
                    counts += np.bincount(found, minlength=buckets)
        hit = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(counts[hit])], ["bucket", "n"])

    found = texts.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in found.collect():  # a row for each bucket at most
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket in thousandths, from its counts in all documents and in the target."""
    n = len(source)
    over, under = float(source.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((t + 1.0) * over / ((s + 1.0) * under))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and ``weight``, the floored mean gain of the features, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            rows = np.zeros((batch.num_rows, 3), np.int64)
            for k, text in enumerate(batch.column("text").to_pylist()):
                for found, words in text_buckets(text, len(gain)):
                    rows[k] += (words, len(found), gain[found].sum())
            weight = rows[:, 2] // np.maximum(rows[:, 1], 1)
            columns = [batch.column("doc_id"), pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(weight)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCORED)


def noise(id_col: str = "doc_id", seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of SHA-256 over seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def draw_order() -> list[Column]:
    """The order of the draw; ``place`` tells rows apart that repeat an id."""
    return [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("place")]


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with their place in the order of the draw from 1 on, as column ``name``.

    Range partitions are stored with their number, so that counts and places are of the same partitions, also when a task
    runs again; a window sees one partition, the sums before are over as many rows as there are partitions.
    """
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *draw_order()).withColumn("part", F.spark_partition_id())
    dealt = stored(dealt, "importance-order")
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*draw_order()))
    return dealt.withColumn("inside", inside).join(offsets, "part").select(*rows.columns, (F.col("inside") + F.col("before")).alias(name))


def cutoff(rows: DataFrame, wanted: int, half_width: float = HALF_WIDTH, accuracy: int = ACCURACY):
    """The ``wanted``-th row of ``rows`` in the order of the draw: (score, doc_id, place).

    The sketch gives scores a little above and below the rank; counts of the rows beyond them are exact. A bracket that
    does not hold the rank gets four times as wide, and at last reaches from the lowest to the highest score.
    """
    total = rows.count()
    while True:
        ranks = [min(1.0, max(0.0, 1 - wanted / total + side * half_width)) for side in (-1, 1)]
        low, high = rows.agg(F.percentile_approx("score", ranks, accuracy).alias("q")).first().q
        if half_width >= 1:
            low, high = rows.agg(F.min("score"), F.max("score")).first()
        above, down_to = rows.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score") >= low)).first()
        if above < wanted <= down_to:
            break
        half_width *= 4
    bracket = rows.where(F.col("score").between(low, high))
    return _numbered(bracket, "rank").where(F.col("rank") == wanted - above).select("score", "doc_id", "place").first()


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text",
    target_col: str = "text", buckets: int = BUCKETS, seed: int = SEED, half_width: float = HALF_WIDTH,
) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` (null if not drawn) of every document.

    Of the documents with at least ``least_words`` words, floor(``percent`` / 100 of their number) are drawn.
    """
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    scored = weights(docs, gain, id_col, text_col).withColumn("score", F.col("weight") + noise("doc_id", seed))
    scored = stored(scored.withColumn("place", F.monotonically_increasing_id()), "importance")
    eligible = scored.where(F.col("n_words") >= least_words)
    wanted = percent * eligible.count() // 100
    plain = scored.drop("place")
    if not wanted:
        return plain.withColumn("rank", F.lit(None).cast("long"))
    last = cutoff(eligible, wanted, half_width)
    later = F.lit(False) if last.doc_id is None else F.col("doc_id").isNull() | (F.col("doc_id") > last.doc_id)
    same = F.col("doc_id").eqNullSafe(F.lit(last.doc_id).cast("long"))
    beyond = (F.col("score") < last.score) | (F.col("score") == last.score) & (later | same & (F.col("place") > last.place))
    drawn = (F.col("n_words") >= least_words) & ~beyond
    left = scored.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return _numbered(scored.where(drawn), "rank").unionByName(left).drop("place")


def drawn_rows(docs: DataFrame, target: DataFrame) -> DataFrame:
    """The rows of query op13."""
    return resampled(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
