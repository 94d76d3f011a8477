"""Document fingerprints: one-permutation MinHash with optimal densification, kept as packed low-order bits.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, shingles are five words (a shorter text is one shingle). Each shingle
is hashed once: the hash names a bin and a value, and a bin keeps its lowest value. An empty bin takes the value of the
first filled bin in an order of its own, a seeded permutation, so every filled bin is equally likely and all texts use the
same orders. Of each value ``BIT`` low-order bits are stored; two texts that share nothing still agree in one of 2 ** BIT
values, and ``likeness`` corrects for that.

Defined cases: null text is empty; a text without words has the empty fingerprint, like only to itself (1) and unlike all
others (0); long texts are hashed whole; ``edited_rows`` orders by id (null first) and then by a hash of the text, so
repeated ids have an order, and a table of one row is its own next document; an empty table gives an empty result; only
the id and text columns are looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actilens.llm.common import (
    ODD, lower_ascii, mix, partitions, ranges, steps, stored, text_bytes, window_hashes, word_hashes, word_spans, worker_state,
)

SHINGLE, BINS, BIT = 5, 256, 4
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _orders() -> np.ndarray:
    """For each bin the order in which it asks the others."""
    rng = np.random.default_rng(5)
    return np.stack([rng.permutation(BINS) for _ in range(BINS)])


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """All shingle hashes of the rows, row after row, and their number for each row."""
    starts, stops, first = word_spans(raw, offsets)
    words = word_hashes(lower_ascii(raw), starts, stops)
    count = np.diff(first)
    many = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
    place = np.repeat(first[:-1], many) + ranges(many)
    out = np.zeros(len(place), np.uint64)
    row = np.repeat(np.arange(len(count)), many)
    for n in range(1, shingle + 1):
        mine = count[row] == n if n < shingle else count[row] >= n
        if mine.any():
            out[mine] = window_hashes(words, n)[place[mine]]
    return out, many


def fingerprints(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low-order bits of the bins (rows x BINS) and which rows have any shingle."""
    hashes, many = shingle_hashes(raw, offsets)
    n = len(many)
    row = np.repeat(np.arange(n), many)
    bins = np.full(n * BINS, EMPTY)
    width = BINS.bit_length() - 1
    np.minimum.at(bins, row * BINS + (hashes >> np.uint64(64 - width)).astype(np.int64), hashes & np.uint64((1 << 64 - width) - 1))
    bins = bins.reshape(n, BINS)
    filled, order = bins != EMPTY, worker_state("bin orders", _orders)
    some = filled.any(axis=1)
    docs, empty = np.nonzero(~filled & some[:, None])
    turn = 0
    while len(docs):
        ask = order[empty, turn]
        hit = filled[docs, ask]
        bins[docs[hit], empty[hit]] = bins[docs[hit], ask[hit]]
        docs, empty, turn = docs[~hit], empty[~hit], turn + 1
    # A value that stands in many bins gives each of them other bits, so few shingles do not agree by chance all at once.
    spread = mix(bins + np.arange(BINS, dtype=np.uint64) * ODD)
    return (spread & np.uint64((1 << BIT) - 1)).astype(np.uint8), some


def packed(low: np.ndarray, some: np.ndarray) -> list[bytes]:
    """Fingerprints as bytes, BIT bits for each bin; empty for rows without shingles."""
    bits = np.unpackbits(low[:, :, None], axis=2, bitorder="little")[:, :, :BIT].reshape(len(low), -1)
    rows = np.packbits(bits, axis=1, bitorder="little")
    return [r.tobytes() if s else b"" for r, s in zip(rows, some)]


def likeness(a: np.ndarray, a_some: np.ndarray, b: np.ndarray, b_some: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity, row by row, corrected for values that agree by chance."""
    chance = 2.0**-BIT
    agree = (a == b).mean(axis=1)
    estimate = np.clip((agree - chance) / (1 - chance), 0, 1)
    return np.where(a_some & b_some, estimate, (a_some == b_some).astype(float))


def _of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return fingerprints(*text_bytes(pa.array(texts, pa.string())))


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many first ones of the next document."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
NAMES = [c.split()[0] for c in ROW.split(", ")]


def _compared(ids: list, texts: list[str], own: tuple, following: list[str], after: tuple) -> list[pa.Array]:
    """The columns of ROW for documents and the documents that follow them."""
    changed = [edited(t, f) for t, f in zip(texts, following)]
    low, some = _of(changed)
    return [
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed], pa.string()),
        pa.array(packed(*own), pa.binary()), pa.array(packed(low, some), pa.binary()),
        pa.array(likeness(*own, low, some), pa.float64()), pa.array(likeness(*own, *after), pa.float64()),
    ]


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's documents, in order. The last one has its successor in another task: it and the first one leave their
    texts for the seams."""
    names, task = [*NAMES, "task", "opens", "closes"], TaskContext.get().partitionId()
    held: tuple | None = None
    opening: str | None = None

    def rows(columns: list[pa.Array], opens: str | None, closes: str | None) -> pa.RecordBatch:
        n = len(columns[0])
        first = pa.array([opens, *[None] * (n - 1)], pa.string())
        last = pa.array([*[None] * (n - 1), closes], pa.string())
        return pa.RecordBatch.from_arrays([*columns, pa.array([task] * n, pa.int64()), first, last], names)

    for batch in steps(batches):
        ids = batch.column("doc_id").to_pylist()
        texts = [t or "" for t in batch.column("text").to_pylist()]
        low, some = _of(texts)
        if held is None:
            opening = texts[0]
        else:
            ids, texts = [held[0], *ids], [held[1], *texts]
            low, some = np.concatenate([held[2], low]), np.concatenate([held[3], some])
        if len(ids) > 1:
            yield rows(_compared(ids[:-1], texts[:-1], (low[:-1], some[:-1]), texts[1:], (low[1:], some[1:])), opening, None)
            opening = None
        held = ids[-1], texts[-1], low[-1:], some[-1:]
    if held is not None:
        blank = _compared([held[0]], [held[1]], held[2:], [""], held[2:])
        yield rows(blank, opening, held[1])


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "closes"):
        texts, after = batch.column("closes").to_pylist(), batch.column("after").to_pylist()
        yield pa.RecordBatch.from_arrays(_compared(batch.column("doc_id").to_pylist(), texts, _of(texts), after, _of(after)), NAMES)


def edited_rows(docs: DataFrame) -> DataFrame:
    """The rows of query op1: each text's fingerprint beside those of its edited text and of the next document.

    Texts move once, into ranges of ids that are sorted inside their tasks. What two tasks must know of each other, one
    text for each of them, is stored and joined by the task's number.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    ordered = narrow.withColumn("tie", F.xxhash64("text")).repartitionByRange(partitions(docs.sparkSession), "doc_id", "tie")
    made = stored(
        ordered.sortWithinPartitions("doc_id", "tie").select("doc_id", "text").mapInArrow(_in_order, f"{ROW}, task long, opens string, closes string"),
        "minhash",
    )
    tasks = made.where("closes is not null").select("task")  # one row for each task
    following = tasks.select("task", F.coalesce(F.lead("task").over(Window.orderBy("task")), F.min("task").over(Window.partitionBy())).alias("next"))
    firsts = made.where("opens is not null").select(F.col("task").alias("next"), F.col("opens").alias("after"))
    last = made.where("closes is not null").select("doc_id", "closes", "task").join(following, "task").join(firsts, "next")
    seams = last.select("doc_id", "closes", "after").mapInArrow(_seams, ROW)
    out = made.where("closes is null").select(*NAMES).unionAll(seams)
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return out.select("doc_id", "n_chars", "edited_sha256", text("fingerprint"), text("edited_fingerprint"), "near_edited", "near_next")
