"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1; a binary classifier for each bit weighs hashed byte n-grams of words (1 to
``LONGEST`` bytes, a space on either side of the word) by the log of how much likelier the n-gram is under the languages
with +1. A document's output for a bit is the mean weight over its n-grams, scaled by how far apart the bit's two sides
were in training. Loss-weighted decoding takes the language whose codeword has the lowest sum over bits of the bit's
weight times log(1 + exp(-output * code)); the softmax of the losses is the score, and a close second is flagged.

Counts per language and n-gram bucket come from all training rows in one pass, added up by Spark: languages x ``BUCKETS``
numbers, however many rows. No row is sampled.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is every text when nothing was learned;
null languages are not learned; one learned language is the answer for any text with a letter; a text without n-grams
seen in training has a tie, which goes to the first language by name; long texts are used whole; null and repeated ids
keep their rows; an empty table gives an empty result; only id, text and (to learn) language are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actilens.llm.common import lower_ascii, mix, ranges, steps, stored, text_bytes, word_hashes, word_spans

LONGEST = 3
BUCKETS = 1 << 15
#: The counts go to the driver, so the number of languages has a limit; more is an error, not a cut.
MAX_LANGUAGES = 500
SHARPNESS, AMBIGUOUS = 8.0, 0.2


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """``n`` rows of +1/-1. Up to 5 languages: all different splits. More: the best of some random codes, by the smallest
    distance between two rows; no column is constant."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        bits = np.arange(1, 1 << (n - 1))
        rows = [np.ones(len(bits))] + [np.where(bits >> k & 1, -1.0, 1.0) for k in range(n - 1)]
        return np.stack(rows)
    rng, width, best = np.random.default_rng(seed), 10 * int(np.ceil(np.log2(n))), None
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (n, width))
        code[0] = np.where(np.abs(code.sum(axis=0)) == n, -code[0], code[0])
        apart = (width - code @ code.T) / 2 + np.eye(n) * width
        if best is None or apart.min() > best[0]:
            best = apart.min(), code
    return best[1]


def word_grams(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of some words, and the number of n-grams of each word."""
    size = stops - starts
    wide = size + 2
    ends = np.cumsum(wide)
    line = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    inner = np.repeat(ends - wide + 1, size) + ranges(size)
    line[inner] = raw[np.repeat(starts, size) + ranges(size)]
    left = np.repeat(ends, wide) - np.arange(len(line))  # bytes from here to the end of the word's stretch
    word = np.repeat(np.arange(len(size)), wide)
    code, found, of = np.zeros(len(line), np.uint64), [], []
    for n in range(1, LONGEST + 1):
        code[: len(line) - n + 1] = code[: len(line) - n + 1] * np.uint64(257) + line[n - 1 :] + np.uint64(1)
        whole = left >= n
        found.append((mix(code[whole] + np.uint64(n)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64))
        of.append(word[whole])
    of_word = np.concatenate(of)
    order = np.argsort(of_word, kind="stable")
    return np.concatenate(found)[order], np.bincount(of_word, minlength=len(size))


def _unique_words(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of one word of each kind, and the kind of every word."""
    _, first, kind = np.unique(word_hashes(raw, starts, stops), return_index=True, return_inverse=True)
    return first, kind


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    scale: np.ndarray

    def outputs(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean n-gram weight of each row for each bit, over the bit's scale."""
        raw = lower_ascii(raw)
        starts, stops, first = word_spans(raw, offsets)
        total = np.zeros((len(offsets) - 1, self.weights.shape[1]))
        if not len(starts):
            return total
        one, kind = _unique_words(raw, starts, stops)
        grams, count = word_grams(raw, starts[one], stops[one])
        per_word = np.add.reduceat(self.weights[grams], np.cumsum(count) - count)
        rows = np.flatnonzero(np.diff(first))
        total[rows] = np.add.reduceat(per_word[kind].astype(np.float64), first[rows])
        n = np.zeros(len(total))
        n[rows] = np.add.reduceat(count[kind], first[rows])
        return total / np.maximum(n, 1)[:, None] / self.scale

    def decode(self, outputs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, score, and the second language's share of the score, for each row."""
        weight = self.scale / self.scale.sum()  # bits with far sides count for more
        loss = np.logaddexp(0, -outputs[:, None, :] * self.code[None, :, :] * 2) @ weight
        best = loss.argmin(axis=1)
        shares = np.exp(-SHARPNESS * (loss - loss.min(axis=1, keepdims=True)))
        shares /= shares.sum(axis=1, keepdims=True)
        top = np.sort(shares, axis=1)
        second = top[:, -2] if shares.shape[1] > 1 else np.zeros(len(shares))
        return best, shares[np.arange(len(best)), best], second


def held_out() -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def gram_counts(rows: DataFrame) -> DataFrame:
    """``lang``, ``bucket``, ``n`` over all rows (``lang``, ``text``): counted in each task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in steps(batches):
            raw, offsets = text_bytes(batch.column("text"))
            raw = lower_ascii(raw)
            starts, stops, first = word_spans(raw, offsets)
            if not len(starts):
                continue
            names, lang = np.unique(np.array(batch.column("lang").to_pylist(), object), return_inverse=True)
            one, kind = _unique_words(raw, starts, stops)
            grams, size = word_grams(raw, starts[one], stops[one])
            of = np.repeat(lang, np.diff(first))
            for k, name in enumerate(names):
                times = np.bincount(kind[of == k], minlength=len(one))
                mine = np.bincount(grams, np.repeat(times, size), BUCKETS).astype(np.int64)
                counts[name] = counts.get(name, 0) + mine
        for name, mine in counts.items():
            bucket = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(bucket), pa.string()), pa.array(bucket), pa.array(mine[bucket])], ["lang", "bucket", "n"])

    return rows.select("lang", "text").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(rows: DataFrame) -> Model | None:
    """A model from the rows with a language; None if no row has one with a word."""
    known = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").alias("text")).where("lang is not null and text is not null")
    summed = stored(gram_counts(known), "gram-counts")
    languages = sorted(r.lang for r in summed.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if not languages:
        return None
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts, number = np.zeros((len(languages), BUCKETS)), {lang: k for k, lang in enumerate(languages)}
    table = summed.toArrow()  # languages x BUCKETS rows at most
    place = np.array([number[lang] for lang in table.column("lang").to_pylist()])
    counts[place, table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
    code = codewords(len(languages))
    sides = [[share[code[:, b] == s].mean(axis=0) if (code[:, b] == s).any() else share.mean(axis=0) for s in (1, -1)] for b in range(code.shape[1])]
    weights = np.stack([np.log(plus / minus) for plus, minus in sides], axis=1)
    # Expected output under each side; half the gap is one unit, and the middle between the sides is zero.
    means = np.array([[(side * weights[:, b]).sum() for side in pair] for b, pair in enumerate(sides)])
    weights = weights - means.mean(axis=1)
    scale = np.maximum((means[:, 0] - means[:, 1]) / 2, 1e-6)
    return Model(languages, code, weights.astype(np.float32), scale)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score``, ``ambiguous`` for every row, from its text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, limit=2 << 20):
            letters = pc.match_substring_regex(pc.fill_null(batch.column("text"), ""), r"\pL").to_numpy(zero_copy_only=False)
            if model is None:
                names, score, second = np.full(len(letters), "und", object), np.zeros(len(letters)), np.zeros(len(letters))
            else:
                best, score, second = model.decode(model.outputs(*text_bytes(batch.column("text"))))
                names = np.where(letters, np.array(model.languages, object)[best], "und")
                score = np.where(letters, score, 0.0)
            close = letters & (second > AMBIGUOUS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(close)], ["doc_id", "lang_pred", "score", "ambiguous"]
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def predicted_rows(docs: DataFrame) -> DataFrame:
    """The rows of query op4."""
    out = predict(docs, fit(docs.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
