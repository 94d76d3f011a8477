"""Duplicate passages by relative Lempel-Ziv parsing against reference blocks.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A passage counts as duplicate where ``WINDOW`` consecutive words start at some
other place too, in any document. Each window is routed by the lowest hash among its 8-word runs, which is the same for
every occurrence; neighbouring windows mostly share it and travel as one run. A bucket of these hashes is a reference
block: it holds every run of the whole corpus that can match inside it, indexed by window. Each run is factored greedily
against the block: a factor begins where the index has an equal window at another place, goes on while the next
window equals the next place of the reference, and where it ends, the window that straddles the boundary is looked up on
its own, so no repeated window is missed. Factors that touch are one span.

A run that a task sees many times goes to its block once, with a mark, and what the block finds comes back under the
run's own hash and meets the occurrences by a join that AQE may split; so a passage shared by a third of all documents
is no hot task. Windows are compared by a 64-bit hash of their words and the 64-bit hash of their anchor, within a block of
few anchors: at 10 ** 13 windows of about 100 under an anchor, less than one unequal pair is expected to pass.

Defined cases: null text has no words; a text shorter than a window loses nothing; repeated rows are places of their own,
so all their windows are duplicate; null and repeated ids keep their rows (rows are told apart by a hash of id and text);
windows overlapping themselves count as other places; a very long text is worked on at once, with about 40 bytes for each of
its words; an empty table gives an empty result; other columns are not looked
at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actilens.llm.common import ODD, _powers, mix, partitions, ranges, steps, text_bytes, window_hashes, word_hashes, word_spans

WINDOW, ANCHOR = 35, 8
#: Windows in a run at most; a longer stretch with one anchor is several runs.
LONGEST_RUN = 64
#: Text of one set of blobs on its way to the blocks.
BATCH_BYTES = 8 << 20


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span, out = 1, values
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - span :]) if span < width else out


def runs(raw: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> dict[str, np.ndarray]:
    """The runs of some texts: window hashes, and for each run its length, row, first word, anchor and key."""
    starts, stops, first = word_spans(raw, offsets)
    words, count = word_hashes(raw, starts, stops), np.diff(first)
    many = np.maximum(count - window + 1, 0)
    place = np.repeat(first[:-1], many) + ranges(many)
    if not len(place):
        none = np.zeros(0, np.int64)
        return {"windows": none.view(np.uint64), "size": none, "row": none, "word": none, "anchor": none.view(np.uint64), "key": none}
    row = np.repeat(np.arange(len(many)), many)
    windows = window_hashes(words, window)[place]
    anchor = _sliding_min(window_hashes(words, min(ANCHOR, window)), window - min(ANCHOR, window) + 1)[place]
    new = np.ones(len(place), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    inside = np.arange(len(place)) - np.repeat(begin, np.diff(begin, append=len(place)))
    begin = np.flatnonzero(inside % LONGEST_RUN == 0)
    size = np.diff(begin, append=len(place))
    power = _powers(LONGEST_RUN)[inside % LONGEST_RUN]
    key = mix(np.add.reduceat(mix(windows) * power, begin) + size.astype(np.uint64) * ODD)
    return {"windows": windows, "size": size, "row": row[begin], "word": (place - first[row])[begin], "anchor": anchor[begin], "key": key.view(np.int64)}


def _blobs(window: int, blocks: int):
    """Each distinct run of a step, packed by reference block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, limit=BATCH_BYTES):
            found = runs(*text_bytes(batch.column("text")), window)
            _, one, times = np.unique(found["key"], return_index=True, return_counts=True)
            if not len(one):
                continue
            block = (mix(found["anchor"][one]) % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            one, times, block = one[order], times[order], block[order]
            size = found["size"][one]
            ends = np.cumsum(found["size"])
            windows = found["windows"][np.repeat((ends - found["size"])[one], size) + ranges(size)]
            cuts = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
            at = np.concatenate([[0], np.cumsum(size)])
            cut = lambda a, kind, by: pa.array([a[x:y].astype(kind).tobytes() for x, y in zip(by, by[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block[cuts[:-1]].astype(np.int32)), cut(windows, "<u8", at[cuts]), cut(size, "u1", cuts), cut(found["key"][one], "<i8", cuts),
                    cut(times > 1, "u1", cuts), cut(found["anchor"][one], "<u8", cuts),
                ],
                ["block", "windows", "sizes", "keys", "many", "anchors"],
            )

    return run


def sources(windows: np.ndarray, run: np.ndarray, anchors: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The reference index: for each window of a block the place of an equal one, or -1.

    Windows are equal if their hashes and the hashes of their anchors are; equal hashes under different anchors are told apart.
    The first of several refers to the second and the others to the first. A run that stands for several
    occurrences refers to its other occurrence, which is itself.
    """
    order = np.argsort(windows, kind="stable")
    alike = windows[order[1:]] == windows[order[:-1]]
    if (alike & (anchors[run[order[1:]]] != anchors[run[order[:-1]]])).any():
        order = np.lexsort((windows, anchors[run]))
        alike = (windows[order[1:]] == windows[order[:-1]]) & (anchors[run[order[1:]]] == anchors[run[order[:-1]]])
    head = np.flatnonzero(np.concatenate([[True], ~alike]))
    group = np.diff(head, append=len(order))
    found = np.full(len(windows), -1, np.int64)
    found[order] = np.where(np.repeat(group, group) > 1, np.repeat(order[head], group), -1)
    twice = head[group > 1]
    found[order[twice]] = order[twice + 1]
    own = np.flatnonzero((found < 0) & (many[run] > 0))
    found[own] = own
    return found


def parse(windows: np.ndarray, sizes: np.ndarray, keys: np.ndarray, many: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factor the runs of a reference block against it: (key, first window, windows) of the spans of each distinct run."""
    run = np.repeat(np.arange(len(sizes)), sizes)
    source = sources(windows, run, anchors, many)
    # A factor goes on while the next window is equal to the next place of the reference; where it ends, in its own run or in
    # that of the reference, the window over the boundary is looked up on its own.
    goes_on = np.zeros(len(windows), bool)
    goes_on[1:] = (run[1:] == run[:-1]) & (source[:-1] >= 0) & (source[1:] == source[:-1] + 1) & (run[source[1:]] == run[source[:-1]])
    begin = np.flatnonzero(~goes_on)
    size = np.diff(begin, append=len(windows))
    # A factor of one window or more is at least as long as a duplicate must be.
    begin, size = begin[source[begin] >= 0], size[source[begin] >= 0]
    # Factors that touch are one span.
    joined = np.ones(len(begin), bool)
    joined[1:] = (begin[1:] != begin[:-1] + size[:-1]) | (run[begin[1:]] != run[begin[:-1]])
    head = np.flatnonzero(joined)
    if not len(head):
        return keys[:0], begin, size
    begin, size = begin[head], np.add.reduceat(size, head)
    # One answer for each distinct run, though several tasks may have sent it.
    _, one = np.unique(keys, return_index=True)
    wanted = np.zeros(len(keys), bool)
    wanted[one] = True
    mine = wanted[run[begin]]
    begin, size = begin[mine], size[mine]
    return keys[run[begin]], begin - (np.cumsum(sizes) - sizes)[run[begin]], size


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's spans once all its blobs are there; blobs come sorted by block."""
    held: list[tuple] = []
    now = None

    def solve() -> pa.RecordBatch:
        parts = [np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*held), ("<u8", "u1", "<i8", "u1", "<u8"))]
        found = parse(parts[0], parts[1].astype(np.int64), *parts[2:])
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in found], ["key", "at", "n"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("block", "windows", "sizes", "keys", "many", "anchors")]
        for block, *blob in zip(*columns):
            if block != now and held:
                yield solve()
                held = []
            now = block
            held.append(blob)
    if held:
        yield solve()


def _occurrences(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            found = runs(*text_bytes(batch.column("text")), window)
            rid = batch.column("rid").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(found["key"]), pa.array(rid[found["row"]]), pa.array(found["word"].astype(np.int64))], ["key", "rid", "word"])

    return run


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, text and a hash of both, which names a row in later joins; equal rows share it, and their spans."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.withColumn("rid", F.xxhash64("doc_id", "text"))


def spans(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """``rid``, ``first`` and ``last``: word ranges covered by duplicate windows, not yet merged, of rows ``rid``, ``text``."""
    blocks = partitions(rows.sparkSession)
    packed = rows.select("text").mapInArrow(_blobs(window, blocks), "block int, windows binary, sizes binary, keys binary, many binary, anchors binary")
    dealt = packed.repartitionById(blocks, F.col("block")).sortWithinPartitions("block")
    factors = dealt.mapInArrow(_parsed, "key long, at long, n long")
    places = rows.select("rid", "text").mapInArrow(_occurrences(window), "key long, rid long, word long")
    begin = F.col("word") + F.col("at")
    return places.join(factors, "key").select("rid", begin.alias("first"), (begin + F.col("n") + window - 2).alias("last"))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        n_words, n_removed, kept = [], [], []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            words = (text or "").encode().split()
            gone = np.zeros(len(words) + 1, np.int64)
            for s in found or ():
                gone[s["first"]] += 1
                gone[s["last"] + 1] -= 1
            stays = np.cumsum(gone)[:-1] == 0
            left = words if stays.all() else [words[i] for i in np.flatnonzero(stays).tolist()]
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            kept.append(b" ".join(left).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept"],
        )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _without(batches):
        sha = [hashlib.sha256(t.encode()).hexdigest() for t in batch.column("kept").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _with_spans(docs: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    rows = _named(docs, id_col, text_col)
    per_row = spans(rows, window).groupBy("rid").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    return rows.join(per_row.hint("shuffle_hash"), "rid", "left").select("doc_id", "text", "spans")


def kept_words(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept`` (the words outside all duplicate windows, joined by one space)."""
    return _with_spans(docs, window, id_col, text_col).mapInArrow(_without, "doc_id long, n_words long, n_removed long, kept string")


def digest_rows(docs: DataFrame) -> DataFrame:
    """The rows of query op9."""
    return _with_spans(docs, WINDOW, "doc_id", "text").mapInArrow(_digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")
