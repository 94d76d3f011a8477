"""Importance resampling against a plain version."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from actilens.llm import importance
from tests.llm.conftest import DOCS, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    return len(words), [zlib.crc32(f.encode()) % 10_000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def plain(rows, target, percent=25):
    found = [features(t) for _, t in rows]
    s, t = collections.Counter(b for _, f in found for b in f), collections.Counter(b for x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    out = []
    for (d, _), (words, f) in zip(rows, found):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in out]


def texts():
    rng = random.Random(8)
    return [prose(rng, rng.randrange(0, 60), 50 if rng.random() < 0.3 else 2000) for _ in range(400)]


@pytest.mark.parametrize("half_width", [importance.HALF_WIDTH, 0.0, 1.0])
def test_draw_matches_the_plain_version(spark, half_width):
    rows = list(enumerate(texts()))
    target = [prose(random.Random(k), 40, 50) for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = importance.resampled(docs, spark.createDataFrame([(t,) for t in target], "text string"), half_width=half_width or 1e-9)
    got = got.select("doc_id", "n_features", "weight", "score", "rank").collect()
    want = plain(rows, target)
    assert sorted(map(tuple, got)) == sorted(want, key=lambda r: r[0]) and sum(r[4] is not None for r in want) > 50


def test_a_bracket_beside_the_cutoff_is_widened(spark, monkeypatch):
    """The sketch is made to point at the wrong end; exact counts notice."""
    rows = spark.createDataFrame([(k, 7 * k % 1000, k) for k in range(1000)], "doc_id long, score long, place long")
    real = F.percentile_approx
    monkeypatch.setattr(importance.F, "percentile_approx", lambda c, p, a: real(c, [0.0, 0.001], a))
    for wanted in (1, 250, 1000):
        assert importance.cutoff(rows, wanted).score == 1000 - wanted


def test_messy_and_empty_tables(spark, messy, messy_rows, no_docs):
    bench = spark.createDataFrame([("he he he",), (None,), ("",)], "text string")
    got = importance.drawn_rows(messy, bench)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    want = plain([(d, t) for d, t, *_ in messy_rows], ["he he he", None, ""])
    bare = lambda rows: sorted((tuple(r)[:4] for r in rows), key=str)
    got = got.collect()
    assert bare(got) == bare(want)
    ranked = lambda rows: [(r[4], r[0], r[3]) for r in sorted((tuple(r) for r in rows if r[4] is not None), key=lambda r: r[4])]
    assert ranked(got) == ranked(want)
    assert importance.drawn_rows(no_docs, bench).collect() == []
    none = importance.drawn_rows(messy, bench.limit(0)).collect()
    assert len(none) == len(messy_rows)


def test_ties_and_repeated_rows(spark):
    """Only part of the rows that are the same is drawn, and ranks have no gaps."""
    docs = spark.createDataFrame([(5, "a b " * 20, "en", "a", 1)] * 30 + [(None, "c d " * 20, None, None, None)] * 30, DOCS).repartition(3)
    ranks = sorted(r.rank for r in importance.drawn_rows(docs, docs.limit(0)).collect() if r.rank is not None)
    assert ranks == list(range(1, 16))


def test_long_texts_go_in_slices(monkeypatch):
    text = prose(random.Random(1), 3000, 700) + " -- end"
    whole = features(text)
    monkeypatch.setattr(importance, "SLICE_BYTES", 64)
    found = list(importance.text_buckets(text))
    assert len(found) > 50 and sum(n for _, n in found) == whole[0]
    assert collections.Counter(b for part, _ in found for b in part.tolist()) == collections.Counter(whole[1])
