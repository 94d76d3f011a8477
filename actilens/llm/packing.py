"""Hierarchical packing of documents into sequences of several context sizes.

A document is its tokens and an end token. Whole windows of the longest context are cut off a long document; what is left is
routed to the tier of the smallest context that holds it. Tiers are packed from the longest to the shortest: a piece opens a
window of its tier, the gap behind it is filled with the largest pieces of the shorter tiers that fit, and when none
fits the shortest piece is cut, so that a window is always full. The rest of a cut piece goes to the tier of its own length.
What cannot fill a window waits for the next documents; at the end of a task it becomes windows of falling powers of two, so
no sequence needs padding at all.

Sequences are dealt over step groups of ``step_tokens`` each: a sequence goes to the fullest open group that holds it, so
groups weigh the same, whatever mixture of contexts they hold; only the last groups of a task may be open.

Each task packs the documents that it reads and holds less than one longest window beside them, so nothing is shuffled, a hot
source is no hot task, and a task that runs again over the same part of a stored table makes the same sequences. Give it
a stored table, not one whose rows come in another order each time.

Defined cases: null text is empty and an empty text is the end token alone; null ids are kept; repeated rows are documents of
their own; a text of any length is cut into windows, its tokens are in memory once; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actilens.llm.common import steps
from actilens.llm.token_files import ENCODE_BYTES, public_tokenizer
from actilens.llm.tokenizing import word_ids

#: Context sizes, ascending powers of two.
TIERS = (256, 512, 1024, 2048, 4096)
#: Tokens of one training step.
STEP_TOKENS = 1 << 16
END_ID = 2
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, window long, step_group long"


class Packer:
    """Packs pieces of documents; ``document`` is any name, pieces are (document, start, length)."""

    def __init__(self, tiers: Sequence[int] = TIERS):
        self.tiers, self.tokens = list(tiers), 0
        #: Waiting pieces of each tier as (length, document, start), ascending.
        self.pools: list[list[tuple[int, int, int]]] = [[] for _ in self.tiers]

    def _route(self, length: int, document: int, start: int) -> None:
        insort(self.pools[bisect_left(self.tiers, length)], (length, document, start))
        self.tokens += length

    def add(self, document: int, length: int) -> Iterator[list[tuple[int, int, int]]]:
        """Whole windows of the longest context; the rest of the document waits in its tier."""
        most = self.tiers[-1]
        for start in range(0, length - most + 1, most):
            yield [(document, start, most)]
        if length % most:
            self._route(length % most, document, length - length % most)

    def _take(self, gap: int) -> tuple[int, int, int]:
        """The largest waiting piece of at most ``gap`` tokens, else the first ``gap`` tokens of the shortest."""
        for tier in range(min(bisect_left(self.tiers, gap), len(self.tiers) - 1), -1, -1):
            pool = self.pools[tier]
            at = bisect_right(pool, (gap, 1 << 62, 0)) - 1
            if at >= 0:
                length, document, start = pool.pop(at)
                self.tokens -= length
                return document, start, length
        length, document, start = next(pool for pool in self.pools if pool).pop(0)
        self.tokens -= length
        self._route(length - gap, document, start + gap)
        return document, start, gap

    def _window(self, size: int) -> list[tuple[int, int, int]]:
        window, gap = [], size
        while gap:
            window.append(self._take(gap))
            gap -= window[-1][2]
        return window

    def full(self) -> Iterator[list[tuple[int, int, int]]]:
        """Full windows, the longest tier with waiting pieces first."""
        for tier in range(len(self.tiers) - 1, -1, -1):
            while self.pools[tier] and self.tokens >= self.tiers[tier]:
                yield self._window(self.tiers[tier])

    def rest(self) -> Iterator[list[tuple[int, int, int]]]:
        """What still waits, as windows of falling powers of two."""
        yield from self.full()
        while self.tokens:
            yield self._window(min(1 << (self.tokens.bit_length() - 1), self.tiers[-1]))


class Groups:
    """Step groups of ``size`` tokens: a sequence goes to the fullest open group with room for it."""

    def __init__(self, size: int):
        self.size, self.made, self.open = size, 0, []

    def place(self, length: int) -> int:
        at = bisect_left(self.open, (length, -1))
        if at == len(self.open):
            self.open.append((self.size, self.made))
            self.made += 1
        room, group = self.open.pop(at)
        if room > length:
            insort(self.open, (room - length, group))
        return group


def packed(
    docs: DataFrame, tokenizer: str, end_id: int = END_ID, tiers: Sequence[int] = TIERS, step_tokens: int = STEP_TOKENS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The pieces of all sequences: ``doc_id``, ``start`` and ``length`` in the document, ``ids`` (little-endian 32-bit
    numbers), ``doc_tokens``, ``sequence_id``, ``offset`` in the sequence, ``window`` (its length) and ``step_group``."""
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(tiers) or step_tokens % tiers[-1]:
        raise ValueError("tiers are ascending powers of two, and a step is a multiple of the longest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, groups = word_ids(tokenizer, end_id), Packer(tiers), Groups(step_tokens)
        base, made, sequences = TaskContext.get().partitionId() << 32, 0, 0
        texts: dict[int, tuple[int | None, np.ndarray, int, int]] = {}  # id, tokens from a place on, that place, size
        columns: list[list] = [[] for _ in PIECES.split(", ")]

        def emit(window: list[tuple[int, int, int]]) -> None:
            nonlocal sequences
            size = sum(n for *_, n in window)
            group, offset = base + groups.place(size), 0
            for document, start, n in window:
                doc_id, ids, first, total = texts[document]
                values = (doc_id, start, n, ids[start - first : start - first + n].tobytes(), total, base + sequences, offset, size, group)
                for column, value in zip(columns, values):
                    column.append(value)
                offset += n
            sequences += 1

        def batch() -> pa.RecordBatch:
            names = [c.split()[0] for c in PIECES.split(", ")]
            made = [pa.array(c, pa.binary() if n == "ids" else pa.int64()) for c, n in zip(columns, names)]
            for column in columns:
                column.clear()
            return pa.RecordBatch.from_arrays(made, names)

        for part in steps(batches, limit=ENCODE_BYTES):
            ids, sizes = encoder.encode(part.column("text"))
            ids, ends = ids.astype("<u4"), np.cumsum(sizes)
            for doc_id, end, size in zip(part.column("doc_id").to_pylist(), ends.tolist(), sizes.tolist()):
                texts[made] = (doc_id, ids[end - size : end], 0, size)
                for window in packer.add(made, size):
                    emit(window)
                made += 1
            for window in packer.full():
                emit(window)
            yield batch()
            waiting = {document: (start, n) for pool in packer.pools for n, document, start in pool}
            # Only the waiting tokens are held on, not the text that they were a part of.
            texts = {d: (texts[d][0], texts[d][1][a - texts[d][2] :][:n].copy(), a, texts[d][3]) for d, (a, n) in waiting.items()}
        for window in packer.rest():
            emit(window)
        yield batch()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def packed_rows(docs: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """The rows of query op11."""
    pieces = packed(docs, public_tokenizer(tokenizer))
    digest = F.crc32("ids").alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", digest, "doc_tokens", "sequence_id", "offset", "window", "step_group")
