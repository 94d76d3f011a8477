"""Helpers shared by the operators: intermediate tables, Arrow batches, words and hashes of words in numpy."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from actilens.session import ensure_checkpoint_dir

#: Bytes of text that one numpy step works on; a longer single document is a step of its own.
STEP_BYTES = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the cluster names in ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there and a lost executor loses nothing."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that meets the other in a shuffle, never a broadcast.

    The planner knows a stored table by its compressed bytes and an exploded one by the bytes before, so a table of many
    short rows passes for small and would be built whole in the driver.
    """
    return df.hint("merge")


def partitions(spark: SparkSession) -> int:
    """Reduce tasks of a hand-made exchange: the session's own setting, which grows with the cluster's data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_state(key: Any, build: Callable[[], Any]) -> Any:
    """``build()`` once for each Python worker.

    Operator code travels by value, so module globals are new in every task; this state hangs on a module of the
    worker process and is found again by the next task.
    """
    holder = sys.modules.setdefault("_actilens_worker_state", types.ModuleType("_actilens_worker_state"))
    found = holder.__dict__.setdefault("values", {})
    if key not in found:
        found[key] = build()
    return found[key]


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about ``limit`` text bytes, at least one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the n + 1 offsets of its rows; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _seeded_bytes() -> np.ndarray:
    out = np.random.default_rng(20240229).integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out[[32, *range(9, 14)]] = 0
    return out


BYTE_VALUE = _seeded_bytes()
IS_WORD = BYTE_VALUE != 0


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that every bit of the input moves every bit of the output."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    """ODD ** 0 .. ODD ** n and more, kept by the worker."""
    have = worker_state("powers", lambda: [np.ones(1, np.uint64)])
    if len(have[0]) <= n:
        table = np.full(max(4096, 2 * n + 2), ODD, np.uint64)
        table[0] = 1
        have[0] = np.cumprod(table)
    return have[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word ``[^\\x20\\x09-\\x0D]+``, and the first word number of each row (n + 1 values)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = IS_WORD[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[edge] = solid[edge]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[last] = solid[last]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each word's bytes, some words at a time: what is held for a byte is much wider."""
    out = np.zeros(len(starts), np.uint64)
    cuts = np.flatnonzero(np.diff(starts // STEP_BYTES, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(starts)]):
        begin, end = starts[a], stops[b - 1]
        at = starts[a:b] - begin
        place = np.arange(end - begin) - np.repeat(at, np.diff(at, append=end - begin))
        longest = int((stops[a:b] - starts[a:b]).max())
        values = BYTE_VALUE[raw[begin:end]]
        values *= _powers(longest)[np.minimum(place, longest)]
        out[a:b] = np.add.reduceat(values, at)
    return mix(out)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words (len(words) - n + 1 values; runs may cross rows)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    if n <= 8:
        power, total, count = _powers(n), np.zeros(len(words) - n + 1, np.uint64), len(words) - n + 1
        for k in range(n):
            total += words[k : k + count] * power[k]
        return mix(total)
    # Prefix sums of word * ODD ** place; a difference divided by ODD ** start does not depend on the place.
    power = _powers(len(words))[: len(words)]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power)])
    inverse = worker_state("inverse", lambda: [np.ones(1, np.uint64)])
    if len(inverse[0]) < len(words):
        table = np.full(len(words) * 2, np.uint64(pow(int(ODD), -1, 2**64)), np.uint64)
        table[0] = 1
        inverse[0] = np.cumprod(table)
    return mix((sums[n:] - sums[:-n]) * inverse[0][: len(words) - n + 1])


def ranges(counts: np.ndarray) -> np.ndarray:
    """0 .. counts[0] - 1, 0 .. counts[1] - 1, ..."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
