"""SimHash near-duplicates by pigeonring filtering.

A 64-bit fingerprint is a ring of 8 segments of 8 bits. If two fingerprints differ in at most 3 bits, there is a segment
from which every chain of l consecutive segments holds at most floor(3 l / 8) differing bits. So for some start i the
segments i and i + 1 agree, and of the segments i + 2 to i + 4 at least two agree: 8 x 3 join keys of 32 bits. The chain
condition is checked for all lengths on what meets under a key; the last length is the full Hamming check.

Defined cases: null text is empty; a text without words has fingerprint zero and links like any other; equal
fingerprints are one node, so any number of copies makes one row before candidates are made; an id may repeat or be
null (a group with null ids only has a null component id); an empty table gives an empty result; other columns of the
input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actilens.llm.common import partitions, shuffled, steps, stored
from actilens.llm.components import components

BITS, SEGMENTS, SEED = 64, 8, 42
#: Whole rows that are taken from Arrow to Python at a time.
ROWS = 500
#: Shingles hashed in one numpy step.
SLICE = 1 << 16
#: Members of a key that one task compares with each other; more are cut into blocks, and pairs of blocks are compared.
BLOCK = 512


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority of the XXH64 bits over the ``shingle``-word runs of the text, A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        runs = [b" ".join(words)]
    else:
        joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
        starts = [0, *ends]
        runs = [joined[a : b - 1] for a, b in zip(starts, ends[shingle - 1 :])]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(runs), SLICE):
        hashes = np.array([digest(r, SEED) for r in runs[at : at + SLICE]], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(runs), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id``, ``fp`` (the 64 bits as a long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            found = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "fp"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, fp long")


def _rotated(x: np.ndarray, start: int) -> np.ndarray:
    by = np.uint64(start * BITS // SEGMENTS)
    return x if not start else (x >> by) | (x << (np.uint64(BITS) - by))


def chain_holds(x: np.ndarray, start: int, most: int) -> np.ndarray:
    """Which differences ``x`` keep within floor(most * l / SEGMENTS) bits for every chain of l segments from ``start``."""
    turned, width = _rotated(x, start), BITS // SEGMENTS
    alive = np.ones(x.shape, bool)
    for length in range(1, SEGMENTS + 1):
        mask = np.uint64((1 << width * length) - 1)
        alive &= np.bitwise_count(turned & mask) <= most * length // SEGMENTS
        if not alive.any():
            break
    return alive


def _keys(fps: DataFrame) -> DataFrame:
    """The 24 join keys of each fingerprint: start, the segment left out, and 32 bits."""
    width = BITS // SEGMENTS
    made = []
    for start in range(SEGMENTS):
        part = lambda k: F.shiftrightunsigned("fp", (start + k) % SEGMENTS * width).bitwiseAND(F.lit(255))
        for free in range(3):
            used = [0, 1, *(k for k in (2, 3, 4) if k != 2 + free)]
            bits = sum((F.shiftleft(part(k), width * n) for n, k in enumerate(used)), F.lit((start * 3 + free) << 32))
            made.append(F.struct(F.lit(start).alias("start"), bits.alias("key")))
    return fps.select("fp", F.inline(F.array(*made)))


def _group_links(fps: np.ndarray, start: int, most: int) -> tuple[list[int], list[int]]:
    """Star links between the members of a small group that are connected within it."""
    n = len(fps)
    near = chain_holds(fps[:, None] ^ fps[None, :], start, most)
    label = np.arange(n)
    while True:
        lower = np.where(near, label[None, :], n).min(axis=1)
        lower = np.minimum(label, lower)[np.minimum(label, lower)]
        if (lower == label).all():
            break
        label = lower
    moved = np.flatnonzero(label != np.arange(n))
    return moved.tolist(), label[moved].tolist()


def links(fps: DataFrame, most: int = 3) -> DataFrame:
    """Links (a, b) that connect all fingerprints ``fp`` (distinct) within ``most`` bits, a star for each group met.

    Keys with one member go first. A key with n members is cut into ceil(n / BLOCK) blocks and every pair of blocks is a
    group of its own, so no task gets more than about two blocks of one key, whatever its size.
    """
    spark = fps.sparkSession
    if not 0 <= most <= 3:
        raise ValueError("the segments are laid out for at most 3 differing bits")
    keyed = _keys(fps)
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("long")
    met = keyed.join(shuffled(counts), "key").withColumn("b", blocks).withColumn("r", F.pmod(F.xxhash64("fp"), F.col("b")))
    others = F.sequence(F.lit(0).cast("long"), F.col("b") - 1)
    paired = met.select("key", "start", "fp", "r", F.explode(others).alias("s"))
    grouped = paired.select("key", "start", "fp", F.least("r", "s").alias("x"), F.greatest("r", "s").alias("y"))
    dealt = grouped.repartition(partitions(spark), "key", "x", "y").sortWithinPartitions("key", "x", "y", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            out, keep = solve(table, last=False)
            rest = table.slice(keep)
            if out:
                yield out
        if rest is not None and rest.num_rows:
            out, _ = solve(rest, last=True)
            if out:
                yield out

    def solve(table: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, int]:
        """Links of the groups that are whole in this table; the last one may go on in the next batch."""
        key, x, y, start = (table.column(c).to_numpy() for c in ("key", "x", "y", "start"))
        fp = table.column("fp").to_numpy().view(np.uint64)
        new = np.flatnonzero((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
        edges = np.concatenate([[0], new, [len(key)] if last else []]).astype(np.int64)
        a, b = edges[:-1], edges[1:]
        size = b - a
        left, right = [], []
        two = a[size == 2]
        for s in range(SEGMENTS):  # the many groups of two in one step
            at = two[start[two] == s]
            hit = at[chain_holds(fp[at] ^ fp[at + 1], s, most)]
            left.append(fp[hit])
            right.append(fp[hit + 1])
        for i in np.flatnonzero(size > 2):
            group = fp[a[i] : b[i]]
            p, q = _group_links(group, int(start[a[i]]), most)
            left.append(group[p])
            right.append(group[q])
        ends = np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)
        if not len(ends[0]):
            return None, int(edges[-1])
        return pa.RecordBatch.from_arrays([pa.array(e) for e in ends], ["a", "b"]), int(edges[-1])

    return dealt.mapInArrow(run, "a long, b long")


def _named(rows: DataFrame, most: int) -> DataFrame:
    """``fp``, ``component_id`` and the group's ``chosen`` (struct of a fingerprint and its lowest id) for the distinct
    fingerprints of ``rows``."""
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-fps")
    roots = components(links(fps.select("fp"), most)).withColumnRenamed("node", "fp")
    labelled = fps.join(shuffled(roots), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    first = F.min(F.struct(F.isnull("low").alias("none"), F.col("low").alias("id"), "fp"))
    groups = labelled.groupBy("root").agg(F.min("low").alias("component_id"), first.alias("chosen"))
    return stored(labelled.join(shuffled(groups), "root").select("fp", "component_id", "chosen"), "simhash-names")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 3) -> DataFrame:
    """``doc_id``, ``fp``, ``component_id`` (the smallest id reachable over links of at most ``most`` bits) for each row."""
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "simhash")
    return rows.join(shuffled(_named(rows, most).select("fp", "component_id")), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 3) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: of the lowest id (a null id is the highest), and of several
    such rows the one with the lowest hash. All columns as they are.

    Rows are stored with their fingerprint, so texts are hashed once; rows that repeat an id and a fingerprint become one
    in the map tasks, and the rest meets the choices of the groups by both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            texts = batch.column("row").field(text_col).to_pylist()
            found = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(found)], ["row", "doc_id", "fp"])

    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"))
    schema = T.StructType([*packed.schema.fields, T.StructField("fp", T.LongType())])
    rows = stored(packed.mapInArrow(run, schema), "simhash-rows")
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    names = _named(rows.select("doc_id", "fp"), most)
    chosen = names.where("fp = chosen.fp").select("fp", key("chosen.id").alias("key"))
    single = rows.groupBy("fp", key("doc_id").alias("key")).agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return single.join(shuffled(chosen), ["fp", "key"]).select("row.*")


def digest_rows(docs: DataFrame) -> DataFrame:
    """The rows of query op10: fingerprint as 16 lowercase hex digits."""
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
