"""Quality classifier: a byte-level convolutional network in numpy.

Each byte becomes a learned vector, a filter looks at two neighbouring rows of ``ROW`` bytes (step: one row), and the
filters' outputs are max-pooled over chunks of two half-chunks of ``HALF`` rows that overlap by one half, so every byte
of the whole text is covered. The mean and the maximum of the chunk vectors over the document go into one logistic unit.

Training takes a bounded sample of labelled rows (``Settings.rows`` and ``Settings.max_chars``, documented there) and runs
on the driver; scoring is one Arrow pass over the documents with a model of a few thousand numbers.

Defined cases: null text is empty, an empty text is one half-chunk of padding and gets a score like any other; long texts
are scored whole; ids may repeat or be null; labels that are null, or whose document is missing, are not learned from; an
id with several labels counts as its lowest; with no label of either class every score is ``Settings.without``; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actilens.llm.common import steps, text_bytes

ROW, HALF = 8, 16
WIDTH = ROW * HALF
THRESHOLD = 0.3


@dataclass(frozen=True)
class Settings:
    """``rows``: labelled rows learned from at most, half of each class where there are enough, those with the lowest hash
    of their id; ``max_chars``: longer texts are not learned from (they are scored whole)."""

    rows: int = 2400
    max_chars: int = 8_192
    depth: int = 6
    filters: int = 24
    epochs: int = 8
    batch: int = 24
    rate: float = 0.02
    decay: float = 1e-4
    seed: int = 7
    without: float = 0.5


def padded(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ROW bytes with each document filled up to whole half-chunks by zeros, and its number of half-chunks."""
    sizes = np.diff(offsets)
    halves = np.maximum(1, -(-sizes // WIDTH))
    at = np.concatenate([[0], np.cumsum(halves)[:-1]]) * WIDTH
    out = np.zeros(int(halves.sum()) * WIDTH, np.uint8)
    out[np.arange(len(raw)) + np.repeat(at - offsets[:-1], sizes)] = raw
    return out.reshape(-1, ROW), halves


def _pool(values: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunk vectors from half-chunk vectors: a chunk is a half and the next one of the same document. Also the documents'
    first chunks and their numbers of chunks."""
    firsts = np.concatenate([[0], np.cumsum(halves)[:-1]])
    lasts = firsts + halves - 1
    follows = np.ones(len(values), bool)
    follows[lasts] = False
    joined = values.copy()
    inside = np.flatnonzero(follows)
    joined[inside] = np.maximum(values[inside], values[inside + 1])
    keep = follows.copy()
    keep[firsts[halves == 1]] = True
    chunks = np.maximum(1, halves - 1)
    return joined[keep], np.concatenate([[0], np.cumsum(chunks)[:-1]]), chunks


class ByteNet:
    """Weights: byte vectors, the two halves of the filters, filter offsets, and the logistic unit over mean and maximum."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.parts = parts

    @classmethod
    def new(cls, s: Settings) -> ByteNet:
        rng = np.random.default_rng(s.seed)
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        vectors = normal(256, s.depth, scale=0.5)
        vectors[0] = 0
        wide = ROW * s.depth
        return cls({
            "vectors": vectors, "left": normal(wide, s.filters, scale=(2 / wide) ** 0.5), "right": normal(wide, s.filters, scale=(2 / wide) ** 0.5),
            "offset": np.zeros(s.filters, np.float32), "unit": normal(2 * s.filters, scale=0.1), "bias": np.zeros(1, np.float32),
        })

    def _filtered(self, rows: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = self.parts
        embedded = p["vectors"][rows].reshape(len(rows), -1)
        out = embedded @ p["left"]
        ahead = embedded @ p["right"]
        ahead[np.concatenate([[0], np.cumsum(halves)[:-1]]) * HALF] = 0  # a document's filters end with it
        out[:-1] += ahead[1:]
        return np.maximum(out + p["offset"], 0), embedded

    def features(self, rows: np.ndarray, halves: np.ndarray) -> np.ndarray:
        """Mean and maximum over the chunk vectors for each document."""
        out, _ = self._filtered(rows, halves)
        chunk, first, count = _pool(out.reshape(-1, HALF, out.shape[1]).max(axis=1), halves)
        mean = np.add.reduceat(chunk, first) / count[:, None].astype(np.float32)
        return np.concatenate([mean, np.maximum.reduceat(chunk, first)], axis=1)

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x = self.features(*padded(raw, offsets)) @ self.parts["unit"] + self.parts["bias"][0]
        return 1 / (1 + np.exp(-np.clip(x.astype(np.float64), -30, 30)))

    def gradient(self, raw: np.ndarray, offsets: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted log loss. Only the rows that win a maximum pass anything on."""
        p = self.parts
        rows, halves = padded(raw, offsets)
        out, embedded = self._filtered(rows, halves)
        k, docs = out.shape[1], len(halves)
        grid = out.reshape(-1, HALF, k)
        winner = grid.argmax(axis=1)
        half = np.take_along_axis(grid, winner[:, None, :], axis=1)[:, 0, :]
        chunk, first, count = _pool(half, halves)
        mean, top = np.add.reduceat(chunk, first) / count[:, None], np.maximum.reduceat(chunk, first)
        x = np.concatenate([mean, top], axis=1)
        error = ((1 / (1 + np.exp(-np.clip(x @ p["unit"] + p["bias"][0], -30, 30))) - label) * weight / docs).astype(np.float32)
        grads = {"unit": x.T @ error, "bias": np.array([error.sum()], np.float32)}
        d_mean = error[:, None] * p["unit"][:k] / count[:, None]
        d_top = error[:, None] * p["unit"][k:]
        d_chunk = np.repeat(d_mean, count, axis=0)
        doc = np.repeat(np.arange(docs), count)
        best = chunk >= top[doc]
        shared = np.add.reduceat(best.astype(np.float32), first)
        d_chunk += np.where(best, (d_top / np.maximum(shared, 1))[doc], 0)
        # A chunk's value came from its own half or from the next one.
        firsts = np.concatenate([[0], np.cumsum(halves)[:-1]])
        own = np.repeat(firsts - first, count) + np.arange(len(chunk))
        after = np.where(np.repeat(halves, count) > 1, own + 1, own)
        second = half[after] > half[own]
        d_half = np.zeros_like(half)
        np.add.at(d_half, own, np.where(second, 0, d_chunk))
        np.add.at(d_half, after, np.where(second, d_chunk, 0))
        # The filter outputs that moved a result, as (row, filter).
        h, f = np.nonzero((d_half != 0) & (half > 0))
        row, value = h * HALF + winner[h, f], d_half[h, f]
        ahead = np.minimum(row + 1, len(rows) - 1)
        opens = np.zeros(len(rows), bool)
        opens[firsts * HALF] = True
        within = (row + 1 < len(rows)) & ~opens[ahead]
        touched = np.zeros(len(rows), bool)
        touched[row] = True
        touched[ahead[within]] = True
        used = np.flatnonzero(touched)
        place = np.cumsum(touched) - 1
        a, b = (
            np.bincount(place[r] * k + c, value[w], len(used) * k).reshape(-1, k).astype(np.float32)
            for r, c, w in ((row, f, slice(None)), (ahead[within], f[within], within))
        )
        e = embedded[used]
        grads |= {"left": e.T @ a, "right": e.T @ b, "offset": a.sum(axis=0)}
        d_embedded = (a @ p["left"].T + b @ p["right"].T).reshape(-1, p["vectors"].shape[1])
        flat = rows[used].ravel()
        grads["vectors"] = np.stack([np.bincount(flat, d_embedded[:, j], 256) for j in range(d_embedded.shape[1])], axis=1).astype(np.float32)
        grads["vectors"][0] = 0
        return grads


def train(texts: list[str], labels: np.ndarray, weights: np.ndarray, s: Settings) -> ByteNet:
    """Adam over shuffled mini-batches; the same sample gives the same weights."""
    net, rng = ByteNet.new(s), np.random.default_rng(s.seed + 1)
    coded = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    m = {k: np.zeros_like(v) for k, v in net.parts.items()}
    v = {k: np.zeros_like(x) for k, x in net.parts.items()}
    step, total = 0, s.epochs * -(-len(texts) // s.batch)
    for _ in range(s.epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), s.batch):
            pick = order[at : at + s.batch]
            offsets = np.concatenate([[0], np.cumsum([len(coded[i]) for i in pick])])
            grads = net.gradient(np.concatenate([coded[i] for i in pick]), offsets, labels[pick], weights[pick])
            step += 1
            rate = s.rate * (1 - step / (total + 1))
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                move = m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                net.parts[k] = (net.parts[k] - rate * (move + s.decay * net.parts[k])).astype(np.float32)
    return net


def held_out() -> F.Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> ByteNet | None:
    """A network from a bounded sample of the labelled rows that are not held out; None without rows of both classes."""
    known = (
        labels.select("doc_id", "quality").where("doc_id is not null and quality in (0, 1)").where(~held_out())
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
    )
    totals = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if len(totals) < 2:
        return None
    half = settings.rows // 2
    order = F.xxhash64(F.lit(settings.seed), "doc_id")
    picks = [known.where(F.col("quality") == q).orderBy(order, "doc_id").limit(half) for q in (0, 1)]
    ids = F.broadcast(picks[0].unionAll(picks[1]))  # settings.rows rows of two numbers at most
    short = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")).where(F.length("text") <= settings.max_chars)
    # One text for each id, so that repeated ids cannot make the sample longer.
    sample = short.join(ids, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    sample.sort(key=lambda r: r.doc_id)
    y = np.array([r.quality for r in sample], np.float32)
    if len(set(y.tolist())) < 2:
        return None
    share = totals[1] / (totals[0] + totals[1])
    weights = np.where(y == 1, share / (y == 1).mean(), (1 - share) / (y == 0).mean()).astype(np.float32)
    return train([r.text for r in sample], y, weights, settings)


def score(docs: DataFrame, net: ByteNet | None, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with ``doc_id`` and ``score`` for every row, in one Arrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, limit=1 << 20):
            raw, offsets = text_bytes(batch.column("text"))
            found = net.score(raw, offsets) if net else np.full(len(offsets) - 1, settings.without)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, "doc_id long, score double")


def scored_rows(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of query op5."""
    out = score(docs, fit(docs, labels, settings), settings)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, net: ByteNet | None, settings: Settings = Settings(), least: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``least``, all columns as they are; nothing is shuffled."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, limit=1 << 20):
            raw, offsets = text_bytes(batch.column("text"))
            found = net.score(raw, offsets) if net else np.full(len(offsets) - 1, settings.without)
            yield batch.filter(pa.array(found >= least))

    return docs.mapInArrow(run, schema)
