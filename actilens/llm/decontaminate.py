"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased, and every run of characters that are neither letters, marks nor digits becomes one space. A test
item of n bytes may differ by e = floor(n * ``error_share``) byte edits from a passage of a document. Cut into e + 1
pieces, at least one piece then occurs unchanged: one Aho-Corasick pass over a document finds all pieces, each hit says
where the item would lie, and Myers' bit-parallel distance decides for the stretch around it.

The test set goes to the tasks in blocks of at most ``block_bytes``; a larger test set makes more blocks and so more
passes, one after the other, never a larger block (a single longer item is a block of its own).

Defined cases: null text is empty and an empty text has no passage; an item without letters or digits matches nothing; an
item too short for an edit (e = 0) must stand as whole words; each item row gives its own rows, so repeated items and
items with a null id do too; repeated documents repeat their rows; empty tables give an empty result; only the id and
text columns are looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actilens.llm.common import steps, worker_state

ERROR_SHARE = 0.06
BLOCK_BYTES = 1 << 20
HIT = "doc_id long, item_id long, distance int, budget int, ends_at long"

Item = tuple[int | None, str]


def normalised(column: pa.Array) -> list[str]:
    """Each text as its normalised UTF-8 bytes, one character for a byte, between two spaces."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(column, "")), pattern=r"[^\pL\pM\pN]+", replacement=" ")
    return [f" {b.decode('latin-1').strip(' ')} " for b in plain.cast(pa.binary()).to_pylist()]


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors`` + 1 pieces of nearly equal length with their places."""
    cuts = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(item: str, masks: dict[str, int], text: str, most: int) -> tuple[int, int] | None:
    """Lowest edit distance (and its first end) between ``item`` and any stretch of ``text``, if it is ``most`` or less."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, None
    for at, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(xh | plus) & full
        down = plus & xh
        if up & top:
            score += 1
        if down & top:
            score -= 1
        if score <= most and (best is None or score < best[0]):
            best = (score, at + 1)
        up = (up << 1) & full  # a match may begin anywhere, so nothing comes in at the low end
        down = (down << 1) & full
        plus = down | ~(xv | up) & full
        minus = up & xv
    return best


class Matcher:
    """The automaton over all pieces of a block of items."""

    def __init__(self, items: list[Item], error_share: float):
        self.items = [(i, t, int(len(t) * error_share)) for i, t in items]
        self.masks: dict[int, dict[str, int]] = {}
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, text, errors) in enumerate(self.items):
            for at, piece in pieces(text, errors) if text else ():
                found[piece].append((k, at))
        self.trie = ahocorasick.Automaton()
        for piece, places in found.items():
            self.trie.add_word(piece, (len(piece), places))
        self.any = bool(found)
        if self.any:
            self.trie.make_automaton()

    def _mask(self, k: int) -> dict[str, int]:
        if k not in self.masks:
            mask: dict[str, int] = defaultdict(int)
            for bit, c in enumerate(self.items[k][1]):
                mask[c] |= 1 << bit
            self.masks[k] = dict(mask)
        return self.masks[k]

    def hits(self, text: str, first: bool = False) -> list[tuple[int, int, int]]:
        """(item number, distance, end) of the items that occur in ``text``; with ``first``, one is enough."""
        if not self.any:
            return []
        begins: dict[int, list[int]] = defaultdict(list)
        for end, (size, places) in self.trie.iter(text):
            for k, at in places:
                begins[k].append(end + 1 - size - at)
        out = []
        for k, at in sorted(begins.items()):
            best = self._best(k, sorted(set(at)), text)
            if best:
                out.append((k, *best))
                if first:
                    break
        return out

    def _best(self, k: int, begins: list[int], text: str) -> tuple[int, int] | None:
        """Distance and end over the stretches around ``begins``; stretches that overlap are one."""
        _, item, errors = self.items[k]
        if not errors:
            whole = [b for b in begins if text[b - 1] == " " and text[b + len(item)] == " "]
            return (0, whole[0] + len(item)) if whole else None
        best = None
        lo, hi = begins[0] - errors, begins[0] + len(item) + errors
        for b in [*begins[1:], None]:
            if b is not None and b - errors <= hi:
                hi = b + len(item) + errors
                continue
            lo = max(0, lo)
            got = myers(item, self._mask(k), text[lo:hi], errors)
            if got and (best is None or got[0] < best[0]):
                best = (got[0], lo + got[1])
            if b is not None:
                lo, hi = b - errors, b + len(item) + errors
        return best


def _matcher(items: list[Item], error_share: float) -> Matcher:
    """One automaton for each worker: the last block's."""
    have = worker_state("benchmark", dict)
    key = (error_share, hash(tuple(items)), len(items))
    if key not in have:
        have.clear()
        have[key] = Matcher(items, error_share)
    return have[key]


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[Item]]:
    """The items with normalised texts, block after block; a block that the driver holds is bounded by ``block_bytes``."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("text is not null")
    size = F.octet_length("text").cast("long")
    total = rows.agg(F.sum(size)).first()[0] or 0
    # Twice as many buckets as needed, and a bucket that is too full is still taken in pieces.
    buckets = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    for n in range(buckets):
        mine = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(buckets)) == n).orderBy("item_id", "text")
        block, held = [], 0
        for r in mine.toLocalIterator():
            text = normalised(pa.array([r.text]))[0].strip(" ")
            if block and held + len(text) > block_bytes:
                yield block
                block, held = [], 0
            block.append((r.item_id, text))
            held += len(text)
        if block:
            yield block


def matches(docs: DataFrame, benchmark: DataFrame, error_share: float = ERROR_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document and test item that occurs in it: ids, lowest distance, its budget, and the first end (byte of
    the normalised text)."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))

    def against(items: list[Item]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(items, error_share)
            for batch in steps(batches):
                rows = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), normalised(batch.column("text"))):
                    rows += [(doc, items[k][0], d, matcher.items[k][2], end) for k, d, end in matcher.hits(text)]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "distance", "budget", "ends_at"])

        return narrow.mapInArrow(run, HIT)

    parts = [against(items) for items in item_blocks(benchmark, block_bytes)]
    return reduce(DataFrame.unionAll, parts) if parts else docs.sparkSession.createDataFrame([], HIT)


def clean(docs: DataFrame, benchmark: DataFrame, error_share: float = ERROR_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows in which a test item occurs; all columns as they are, nothing is shuffled."""

    def without(frame: DataFrame, items: list[Item]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(items, error_share)
            for batch in steps(batches):
                yield batch.filter(pa.array([not matcher.hits(t, first=True) for t in normalised(batch.column("text"))]))

        return frame.mapInArrow(run, frame.schema)

    return reduce(without, item_blocks(benchmark, block_bytes), docs)
