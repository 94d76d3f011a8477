"""Stupid-backoff scores of documents, computed relationally over n-gram counts of the whole corpus.

Tokens come from a public tokenizer, so unigram counts have as many rows as its vocabulary and every task may hold them.
A token t after p scores count(p, t) / count(p) where the pair occurs, and else ``BACKOFF`` * count(t) / (all tokens); the
first token of a document scores count(t) / (all tokens). All counts are kept. A document is scored by the rest of the
corpus: its own occurrences are taken off count(p, t), as a pair that only it holds would otherwise always be certain; a copy
of it is another document. ``leave_out`` can be turned off. The score is the mean natural log of a token.

Pair counts are partitioned by hash of the pair, and joined there to the pairs of each document, in packed form: rows of
one pair each would take a multiple of the input on disk. Each task sends, for every bucket, the distinct pairs of a stretch of
documents with the documents they stand in; a bucket thus has all occurrences of its pairs, counts them, and sends back
one sum for each document it saw. Sums meet at the stretch they came from. A pair can only be frequent if both its tokens
are: pairs of tokens that make up at least 1 / ``HOT`` of the corpus (``HOT`` tokens at most, so ``HOT`` ** 2 pairs) are
counted beforehand and scored where they stand, and no bucket gets a pair with more than 1 / ``HOT`` of the corpus.

Defined cases: null text is empty; a text without tokens has the sum 0 over 0 tokens, and its score is null; copies count each
time; null and repeated ids keep their rows; a very long text is a stretch of its own, and its tokens are in memory at once;
an empty table gives an empty result; only id and text are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actilens.llm.common import mix, partitions, ranges, steps, stored
from actilens.llm.token_files import batch_ids, encoded, public_tokenizer, token_counts
from actilens.llm.tokenizing import id_type

BACKOFF = 0.4
HOT = 1024
#: Tokens of one stretch of documents, about; a document counts as ``ROW_TOKENS`` more.
STRETCH, ROW_TOKENS = 1 << 19, 16
#: kind 0: what is known of a stretch; 1 and 2: its pairs of a bucket, with counts of 16 or 32 bits.
PACKED = "kind int, bucket int, stretch long, keys binary, sizes binary, docs binary, names array<long>"


class Unigrams:
    """Counts by token, their logs, and the frequent tokens with their numbers."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.total = counts, max(int(counts.sum()), 1)
        with np.errstate(divide="ignore"):
            self.log = np.log(counts.astype(np.float64))
        self.log_total = float(np.log(self.total))
        frequent = np.flatnonzero(counts * HOT >= self.total) if counts.any() else np.zeros(0, np.int64)
        self.frequent = frequent
        self.number = np.full(len(counts) + 1, -1, np.int64)
        self.number[frequent] = np.arange(len(frequent))

    def alone(self, token: np.ndarray) -> np.ndarray:
        return self.log[token] - self.log_total

    def pair(self, before: np.ndarray, token: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Log score of tokens after others, with the count of each pair."""
        return np.where(count > 0, np.log(np.maximum(count, 1)) - self.log[before], np.log(BACKOFF) + self.alone(token))

    def sums(self, doc: np.ndarray, before: np.ndarray, token: np.ndarray, count: np.ndarray, leave_out: bool, docs: int) -> np.ndarray:
        """Summed log scores of ``docs`` documents for pairs (sorted by pair and document) with their counts in the corpus."""
        if not len(doc):
            return np.zeros(docs)
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (token[1:] != token[:-1]) | (before[1:] != before[:-1])])
        head = np.flatnonzero(new)
        own = np.diff(head, append=len(doc))
        log = self.pair(before[head], token[head], count[head] - own if leave_out else count[head])
        return np.bincount(doc[head], log * own, docs)


def _pairs(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the second tokens of all pairs, their documents, and the first places of documents with tokens."""
    size = np.diff(starts)
    doc = np.repeat(np.arange(len(size)), size)
    second = np.ones(len(ids), bool)
    first = starts[:-1][size > 0]
    second[first] = False
    place = np.flatnonzero(second)
    return place, doc[place], first


def hot_pairs(rows: DataFrame, unigrams: Unigrams, kind: str) -> np.ndarray:
    """Counts of all pairs of frequent tokens, as a square table."""
    n = len(unigrams.frequent)
    if not n:
        return np.zeros((0, 0), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n * n, np.int64)
        for batch in steps(batches, "ids", STRETCH * np.dtype(kind).itemsize):
            ids, starts = batch_ids(batch.column("ids"), kind)
            place, _, _ = _pairs(ids, starts)
            a, b = unigrams.number[ids[place - 1]], unigrams.number[ids[place]]
            both = (a >= 0) & (b >= 0)
            counts += np.bincount(a[both] * n + b[both], minlength=n * n)
        pair = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(counts[pair])], ["pair", "n"])

    found = rows.select("ids").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(n * n, np.int64)
    table[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return table.reshape(n, n)


def _stretches(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in steps(batches, "ids", STRETCH * np.dtype(kind).itemsize):
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column("ids"))).as_py() // np.dtype(kind).itemsize + ROW_TOKENS * batch.num_rows
        if size >= STRETCH:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _sent(unigrams: Unigrams, hot: np.ndarray, buckets: int, kind: str, leave_out: bool):
    """What a task sends: one row with the documents of a stretch and what is known of them, and the pairs by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PACKED.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        for number, table in enumerate(_stretches(batches, kind)):
            stretch = (TaskContext.get().partitionId() << 24) + number
            ids, starts = batch_ids(table.column("ids").chunk(0), kind)
            ids = ids.astype(np.int32)
            place, doc, first = _pairs(ids, starts)
            known = np.zeros(len(starts) - 1)
            known[np.flatnonzero(np.diff(starts))] = unigrams.alone(ids[first])
            before, token = ids[place - 1], ids[place]
            a, b = unigrams.number[before], unigrams.number[token]
            both = (a >= 0) & (b >= 0)
            n = len(unigrams.frequent)
            square = (doc[both] * n + a[both]) * n + b[both]
            square.sort()
            at, x, y = square // (n * n) if n else square, square // n % n if n else square, square % n if n else square
            known += unigrams.sums(at, unigrams.frequent[x], unigrams.frequent[y], hot[x, y], leave_out, len(known))
            back = (~both).sum()
            names_of = table.column("doc_id").to_pylist()
            row = [[0], [-1 - stretch % buckets], [stretch], [known.tobytes()], [np.diff(starts).tobytes()], [b""], [names_of]]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names)
            if not back:
                continue
            key, doc = (before[~both].astype(np.int64) << 32) | token[~both], doc[~both]
            order = np.argsort(key, kind="stable")  # documents stay in order inside a pair
            key, doc = key[order], doc[order]
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(head, append=len(key))
            bucket = (mix(key[head].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            by_bucket = np.argsort(bucket, kind="stable")
            doc = doc[np.repeat(head[by_bucket], size[by_bucket]) + ranges(size[by_bucket])]
            key, size, distinct = key[head][by_bucket], size[by_bucket], bucket[by_bucket]
            cuts = np.flatnonzero(np.diff(distinct, prepend=-1, append=-1))
            ends = np.concatenate([[0], np.cumsum(size)])[cuts]
            wide = "<u2" if len(known) <= 1 << 16 else "<u4"
            cut = lambda x, kind, by: [x[p:q].astype(kind).tobytes() for p, q in zip(by, by[1:])]
            n = len(cuts) - 1
            columns = [
                [1 + (size.max() >= 1 << 16)] * n, distinct[cuts[:-1]].tolist(), [stretch] * n, cut(key, "<i8", cuts), cut(size, "<u2" if size.max() < 1 << 16 else "<u4", cuts),
                cut(doc, wide, ends), [[len(known)]] * n,
            ]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], names)

    return run


SUMS = "stretch long, kind int, docs binary, sums binary, sizes binary, names array<long>"


def _bucket_sums(unigrams: Unigrams, leave_out: bool):
    """Count the pairs of each bucket and send every stretch the sums of its documents; rows of kind 0 pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SUMS.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        row = lambda *v: pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(v, kinds)], names)

        def solve(held: list[dict]) -> Iterator[pa.RecordBatch]:
            keys = [np.frombuffer(h["keys"], "<i8") for h in held]
            sizes = [np.frombuffer(h["sizes"], "<u2" if h["kind"] == 1 else "<u4").astype(np.int64) for h in held]
            every, kind = np.unique(np.concatenate(keys), return_inverse=True)
            count = np.bincount(kind, np.concatenate(sizes), len(every))
            at = 0
            for h, key, size in zip(held, keys, sizes):
                wide = "<u2" if h["names"][0] <= 1 << 16 else "<u4"
                doc = np.frombuffer(h["docs"], wide).astype(np.int64)
                pair, times = np.repeat(key, size), np.repeat(count[kind[at : at + len(key)]].astype(np.int64), size)
                total = unigrams.sums(doc, pair >> 32, pair & 0xFFFFFFFF, times, leave_out, h["names"][0])
                at += len(key)
                some = np.flatnonzero(total)  # a log score is never 0 but for a pair that is certain
                yield row(h["stretch"], 1, some.astype("<u4").tobytes(), total[some].tobytes(), b"", [])

        held: list[dict] = []
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                if held and r["bucket"] != held[0]["bucket"]:
                    yield from solve(held)
                    held = []
                if r["kind"] == 0:
                    yield row(r["stretch"], 0, b"", r["keys"], r["sizes"], r["names"])
                else:
                    held.append(r)
        if held:
            yield from solve(held)

    return run


SCORE = "doc_id long, n_tokens long, log_score double"


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each stretch with all their sums; a stretch begins with its row of kind 0."""
    now: tuple | None = None

    def done() -> pa.RecordBatch:
        names, sizes, total = now
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sizes), pa.array(total)], ["doc_id", "n_tokens", "log_score"])

    for batch in batches:
        for at in range(batch.num_rows):
            r = batch.slice(at, 1).to_pylist()[0]
            if r["kind"] == 0:
                if now:
                    yield done()
                now = r["names"], np.frombuffer(r["sizes"], np.int64), np.frombuffer(r["sums"], np.float64).copy()
            else:
                np.add.at(now[2], np.frombuffer(r["docs"], "<u4"), np.frombuffer(r["sums"], np.float64))
    if now:
        yield done()


def scores(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", leave_out: bool = True) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``score`` (mean log of a token) and ``sum_log`` for every row, against the counts of all rows."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = stored(encoded(narrow, [], tokenizer, None).select("doc_id", "ids"), "lm-ids")
    kind = id_type(tokenizer)
    counts = token_counts(rows, kind)
    dense = np.zeros(max(counts, default=-1) + 1, np.int64)
    dense[list(counts)] = list(counts.values())
    unigrams = Unigrams(dense)
    buckets = partitions(spark)
    sent = rows.mapInArrow(_sent(unigrams, hot_pairs(rows, unigrams, kind), buckets, kind, leave_out), PACKED)
    target = F.when(F.col("bucket") < 0, -1 - F.col("bucket")).otherwise(F.col("bucket"))
    counted = sent.repartitionById(buckets, target).sortWithinPartitions("bucket", "stretch").mapInArrow(_bucket_sums(unigrams, leave_out), SUMS)
    totals = counted.repartition(buckets, "stretch").sortWithinPartitions("stretch", "kind").mapInArrow(_totals, SCORE)
    mean = F.when(F.col("n_tokens") > 0, F.round(F.col("log_score") / F.col("n_tokens"), 6))
    return totals.select("doc_id", "n_tokens", mean.alias("score"), F.round("log_score", 6).alias("sum_log"))


def scored_rows(docs: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """The rows of query op8."""
    return scores(docs, public_tokenizer(tokenizer))
