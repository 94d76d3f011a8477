"""One-permutation MinHash and SimHash groups against plain versions."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from actilens.llm import minhash, simhash
from actilens.llm.common import text_bytes, window_hashes, word_hashes, word_spans
from actilens.llm.components import components


def shingles(text, n=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\né\x1c ", max_size=30), max_size=8))
def test_words_of_a_batch_are_the_words_of_each_text(texts):
    raw, offsets = text_bytes(pa.array(texts, pa.string()))
    starts, stops, first = word_spans(raw, offsets)
    found = [[bytes(raw[a:b]) for a, b in zip(starts[p:q], stops[p:q])] for p, q in zip(first, first[1:])]
    assert found == [t.encode().split() for t in texts]
    hashes = word_hashes(raw, starts, stops).tolist()
    by_word = {}
    for word, h in zip([w for row in found for w in row], hashes):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_window_hashes_depend_on_the_words_alone():
    words = np.array([5, 6, 7, 8, 9] * 20, np.uint64)
    for n in (1, 3, 8, 9, 35):
        found = window_hashes(words, n)
        assert len(found) == 101 - n and len(set(found.tolist())) == 5
        assert (found[5:] == found[:-5]).all()


def test_edited_rows(messy, messy_rows, no_docs):
    got = minhash.edited_rows(messy).collect()
    assert len(got) == len(messy_rows) and minhash.edited_rows(no_docs).collect() == []
    by_text = {}
    for doc, text, *_ in messy_rows:
        by_text.setdefault(doc, []).append(text or "")
    for row in got:
        assert row.n_chars in {len(t) for t in by_text[row.doc_id]}
    unique = sorted(d for d, t in by_text.items() if d is not None and len(t) == 1)
    rows = {r.doc_id: r for r in got}
    for a, b in zip(unique, unique[1:]):
        if b != a + 1:
            continue
        x, y = by_text[a][0], by_text[b][0]
        changed = x[: len(x) - len(x) // 4] + y[: len(x) // 4]
        assert rows[a].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        for near, other in ((rows[a].near_edited, changed), (rows[a].near_next, y)):
            mine, its = shingles(x), shingles(other)
            assert abs(near - (len(mine & its) / len(mine | its) if mine | its else 1.0)) < 0.2
        assert (rows[a].fingerprint == rows[b].fingerprint) == (shingles(x) == shingles(y))
    last = max(unique)
    assert rows[last].n_chars == len(by_text[last][0])


def test_one_document_is_its_own_next(spark):
    row = minhash.edited_rows(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")).first()
    assert row.near_next == 1.0 and row.n_chars == 15


def test_likeness_is_unbiased():
    rng = random.Random(2)
    words = [f"v{k}" for k in range(100_000)]
    errors = []
    for share in (0.0, 0.3, 0.6, 0.9):
        for _ in range(25):
            n = rng.randrange(40, 600)
            a = rng.choices(words, k=n)
            cut = int(n * share)
            b = a[:cut] + rng.choices(words, k=n - cut)
            low, some = minhash.fingerprints(*text_bytes(pa.array([" ".join(a), " ".join(b)])))
            x, y = shingles(" ".join(a)), shingles(" ".join(b))
            errors.append(minhash.likeness(low[:1], some[:1], low[1:], some[1:])[0] - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.05


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_groups_match_all_pairs(messy, messy_rows, no_docs):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.digest_rows(messy).collect()]
    fps = {}
    for doc, text, *_ in messy_rows:
        fps.setdefault(plain_fingerprint(text), []).append(doc)
    nodes = list(fps)
    near = [(a, b) for i, a in enumerate(nodes) for b in nodes[:i] if (a ^ b).bit_count() <= 3]
    root, lowest = plain_components(nodes, near), {}
    for fp, ids in fps.items():
        lowest.setdefault(root[fp], []).extend(i for i in ids if i is not None)
    want = [(d, f"{fp:016x}", min(lowest[root[fp]], default=None)) for fp, ids in fps.items() for d in ids]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert simhash.digest_rows(no_docs).collect() == []


def test_links_of_random_and_crowded_fingerprints(spark):
    """Crowds under one key are cut into pairs of blocks; what is connected must stay so."""
    rng = random.Random(4)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(40), rng.randrange(6))) for _ in range(1500)}
    fps |= {rng.getrandbits(64) for _ in range(300)}
    for fp in list(fps)[-100:]:
        fps.add(fp ^ sum(1 << b for b in rng.sample(range(64), 3)))
    nodes = sorted(fps)
    signed = [n - (1 << 64) if n >= 1 << 63 else n for n in nodes]
    found = simhash.links(spark.createDataFrame([(n,) for n in signed], "fp long")).collect()
    array = np.array(nodes, np.uint64)
    a, b = np.nonzero(np.triu(np.bitwise_count(array[:, None] ^ array[None, :]) <= 3, 1))
    want = plain_components(range(len(nodes)), zip(a.tolist(), b.tolist()))
    number = {n: i for i, n in enumerate(signed)}
    have = plain_components(range(len(nodes)), [(number[r.a], number[r.b]) for r in found])
    assert have == want


def test_the_chain_condition_loses_no_near_pair():
    rng = random.Random(6)
    for bits in range(4):
        x = np.array([sum(1 << b for b in rng.sample(range(64), bits)) for _ in range(500)], np.uint64)
        kept = np.zeros(len(x), bool)
        for start in range(simhash.SEGMENTS):
            kept |= simhash.chain_holds(x, start, 3)
        assert kept.all()


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 200), (300, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{k: 100 for k in range(101, 140)}, 201: 200}


def test_one_of_each(messy, messy_rows):
    kept = simhash.one_of_each(messy)
    assert kept.dtypes == messy.dtypes
    rows = kept.select("doc_id", "text").collect()
    groups = {(r.component_id, r.fp) for r in simhash.near_groups(messy).collect()}
    assert len(rows) == len({c for c, _ in groups if c is not None}) + len({f for c, f in groups if c is None})
    repeated = next(t for d, t, *_ in messy_rows if d == 13)
    assert sum(r.text == repeated for r in rows) == 1


def test_simhash_joins_send_no_table_to_the_driver(spark, messy):
    fps = spark.range(300).selectExpr("xxhash64(id) as fp")
    for df in (simhash.links(fps), simhash.near_groups(messy), simhash.one_of_each(messy)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
