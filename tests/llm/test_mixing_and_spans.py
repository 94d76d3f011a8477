"""Pfair schedules and duplicate spans against plain versions, and the pipeline."""

import collections
import hashlib
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from actilens.llm import duplicate_spans, mixing
from tests.llm.conftest import DOCS, prose
from tests.llm.test_fingerprints import plain_components, plain_fingerprint


def plain_run(weights, slots):
    """Earliest deadline first on exact fractions, slot by slot."""
    total, done, picks = sum(weights.values()), collections.Counter(), []
    for t in range(slots):
        ready = [(-(-(done[s] + 1) * total // w), s) for s, w in sorted(weights.items()) if done[s] * total // w <= t]
        picks.append(min(ready)[1])
        done[picks[-1]] += 1
    return picks


#: Targets that no short period holds: nearly equal thirds, one far below a thousandth, many small ones beside a large one.
TARGETS = [
    {"a": 1.0}, {"a": 0.33374, "b": 0.33306, "c": 0.33320}, {"a": 0.0003, "b": 0.4, "c": 0.5997}, {"a": 0.5, **{f"s{k}": 0.5 / 37 + k * 1e-7 for k in range(37)}},
    {"a": 13.1, "b": 11.7, "c": 5.3, "d": 3.9, "e": 0.61},
]


@pytest.mark.parametrize("number,cells", [(0, 7), (1, 50), (1, 10**6), (2, 5000), (3, 101), (4, 64), (4, 333)])
def test_every_source_is_less_than_a_block_off_its_target(spark, number, cells):
    target, slots = TARGETS[number], 12_000 if number == 2 else 700
    counts = [(s, max(1, int(slots * w / sum(target.values())))) for s, w in target.items()]
    given = spark.createDataFrame([(s, w) for s, w in target.items()], "source string, weight double")
    weighed = mixing.whole_weights(spark.createDataFrame([("=" + s, n) for s, n in counts], "s string, n long"), given)
    table = mixing.slot_table(weighed, block_docs=1, cell_slots=cells).collect()
    picks = {r.slot: r for r in table}
    assert sorted(picks) == list(range(len(table))) and len(table) >= 0.9 * slots
    served, whole = collections.Counter(), sum(target.values())
    for t in range(len(table)):
        r = picks[t]
        assert r.block == served[r.s] and r.block * r.total // r.weight <= t < -(-(r.block + 1) * r.total // r.weight)
        served[r.s] += 1
        assert all(abs(served["=" + s] - (t + 1) * w / whole) < 1 for s, w in target.items())
    if cells > len(table):
        exact = {r.s: r.weight for r in weighed.collect()}
        assert [picks[t].s for t in range(len(table))] == plain_run(exact, len(table))


def test_schedule_of_messy_and_empty_tables(messy, messy_rows, no_docs):
    rows = mixing.schedule(messy, block_docs=4, cell_slots=8).select("row.doc_id", "row.source", "block", "release", "deadline", "slot", "place").collect()
    assert sorted((str(r.doc_id), str(r.source)) for r in rows) == sorted((str(r[0]), str(r[3])) for r in messy_rows)
    blocks = collections.defaultdict(list)
    for r in rows:
        assert r.release <= r.slot < r.deadline
        blocks[r.source, r.block, r.slot].append(r.place)
    assert len({slot for *_, slot in blocks}) == len(blocks)  # a slot holds one block
    for source in {r.source for r in rows}:
        mine = sorted((b, len(p)) for (s, b, _), p in blocks.items() if s == source)
        assert [b for b, _ in mine] == list(range(len(mine))) and all(n == 4 for _, n in mine[:-1])
        assert all(sorted(p) == list(range(len(p))) for (s, *_), p in blocks.items() if s == source)
    assert mixing.schedule_rows(no_docs).collect() == [] and mixing.mixed(no_docs).count() == 0


def test_given_weights_hold_until_a_source_ends(spark):
    docs = spark.createDataFrame([(k, "t", "abc"[k % 3], None, 1) for k in range(1500)], "doc_id long, text string, source string, lang string, n_chars long")
    target = {"a": 0.6, "b": 0.3, "c": 0.1}
    weights = spark.createDataFrame([*[(s, 10 * w) for s, w in target.items()], ("nowhere", 5.0)], "source string, weight double")
    rows = mixing.schedule(docs, weights, block_docs=5, cell_slots=40).select("row.source", "slot").collect()
    order = sorted((r.slot, r.source) for r in rows)
    until = min(max(s for s, x in order if x == source) for source in "abc")
    for t in range(1, until, 7):
        served = collections.Counter(x for s, x in order if s < t)
        assert all(abs(served[x] / 5 - t * target[x]) < 1 for x in "abc")


def test_mixed_files_hold_the_schedule(spark, messy, tmp_path):
    mixed = mixing.mixed(messy)
    assert mixed.schema == messy.schema
    mixed.write.parquet(f"{tmp_path}/mix")
    back = spark.read.parquet(f"{tmp_path}/mix")
    got = back.orderBy(F.col("_metadata.file_name"), F.col("_metadata.row_index")).select("doc_id").collect()
    want = mixing.schedule(messy).orderBy("slot", "place").select("row.doc_id").collect()
    assert [r.doc_id for r in got] == [r.doc_id for r in want]


def test_schedule_matches_sql(spark, small_folder):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{small_folder}/documents.parquet')")
    rows = mixing.schedule_rows(spark.read.parquet(f"{small_folder}/documents.parquet"))
    want = con.execute(f"select {', '.join(rows.columns)} from ({mixing.SCHEDULE_SQL.strip()})").fetchall()
    assert sorted(map(tuple, rows.collect())) == sorted(want)


def plain_spans(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_spans_of_messy_and_empty_tables(messy, messy_rows, no_docs):
    got = duplicate_spans.digest_rows(messy).collect()
    want = [(d, *rest) for (d, *_), rest in zip(messy_rows, plain_spans([t for _, t, *_ in messy_rows], 35))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and sum(w[2] for w in want) > 300
    assert duplicate_spans.digest_rows(no_docs).collect() == []


@pytest.mark.parametrize("window", [3, 9, 35])
def test_spans_of_overlapping_copies(spark, window):
    rng = random.Random(window)
    pool = [prose(rng, 200, 30) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            words = rng.choice(pool).split()
            a = rng.randrange(150)
            parts += words[a : a + rng.randrange(1, 80)] if rng.random() < 0.7 else prose(rng, rng.randrange(60), 5000).split()
        texts.append(" ".join(parts))
    texts += ["go " * 100, "go on " * 50, texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in duplicate_spans.kept_words(docs, window).collect()}
    assert [got[k] for k in range(len(texts))] == plain_spans(texts, window)


lists_of_windows = st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=12), min_size=1, max_size=8)


def parsed(lists, anchors, many=0):
    windows = np.array([w for row in lists for w in row], np.uint64)
    sizes = np.array([len(row) for row in lists])
    key, at, n = duplicate_spans.parse(windows, sizes, np.arange(len(lists)), np.full(len(lists), many, np.uint8), np.array(anchors, np.uint64))
    return {(int(k), int(a) + i) for k, a, m in zip(key, at, n) for i in range(int(m))}


@settings(max_examples=80, deadline=None)
@given(lists_of_windows, st.lists(st.integers(0, 1), min_size=8, max_size=8))
def test_parse_of_a_block(lists, anchors):
    anchors = anchors[: len(lists)]
    count = collections.Counter((a, w) for a, row in zip(anchors, lists) for w in row)
    assert parsed(lists, anchors) == {(k, i) for k, row in enumerate(lists) for i, w in enumerate(row) if count[anchors[k], w] > 1}
    assert parsed(lists, anchors, many=1) == {(k, i) for k, row in enumerate(lists) for i in range(len(row))}


def test_without_the_reference_nothing_is_found(monkeypatch):
    lists = [[1, 2, 3, 4], [9, 2, 3, 8], [1, 2, 3, 4]]
    assert len(parsed(lists, [0, 0, 0])) == 10
    monkeypatch.setattr(duplicate_spans, "sources", lambda windows, *_: np.full(len(windows), -1))
    assert parsed(lists, [0, 0, 0]) == set()


def lowest_of_groups(texts):
    """The lowest id of each group of near fingerprints, all pairs held against each other."""
    prints = {d: plain_fingerprint(t) for d, t in texts.items()}
    ids = sorted(prints)
    near = [(a, b) for k, b in enumerate(ids) for a in ids[:k] if (prints[a] ^ prints[b]).bit_count() <= 3]
    return sorted(set(plain_components(ids, near).values()))


def test_the_pipeline(spark, small_folder, tmp_path):
    docs = spark.read.parquet(f"{small_folder}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    benchmark = [r.text for r in spark.read.parquet(f"{small_folder}/benchmark.parquet").collect()]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small_folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            now = {r.doc_id: r.text for r in docs.collect()}
            assert all(before[d] == t for d, t in now.items())
            if name == "near_duplicates":
                assert sorted(now) == lowest_of_groups(before)
            if name == "decontamination":
                leaked = {d for d, t in before.items() if any(b in t for b in benchmark)}
                assert set(now) == set(before) - leaked
            if name == "mixing":
                assert now == before
            before = now
    assert sorted(r.doc_id for r in docs.collect()) == sorted(before)


def test_the_pipeline_on_an_empty_table(spark, small_folder, tmp_path):
    docs = spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small_folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() == 0
