"""Packed sequences: every token once, windows full, groups even, ids as the library gives them."""

import collections
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from actilens.llm import packing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 9), st.integers(1, 70)), max_size=60), st.integers(1, 8))
def test_windows_are_full_and_hold_every_token_once(sizes, flush):
    packer, windows = packing.Packer((4, 8, 16)), []
    for k, n in enumerate(sizes):
        windows += packer.add(k, n)
        if k % flush == 0:
            windows += packer.full()
            assert packer.tokens < 16
    last = len(windows)
    windows += packer.rest()
    lengths = [sum(n for *_, n in w) for w in windows]
    assert all(n in (4, 8, 16) for n in lengths[:last]) and all(n & (n - 1) == 0 and n <= 16 for n in lengths)
    assert len(lengths) - last <= len(sizes) + 5
    seen = collections.Counter((d, s + k) for w in windows for d, s, n in w for k in range(n))
    assert seen == collections.Counter((d, k) for d, n in enumerate(sizes) for k in range(n))


def test_gaps_are_filled_from_shorter_tiers_before_anything_is_cut():
    packer = packing.Packer((4, 8, 16))
    assert [list(packer.add(k, n)) for k, n in enumerate([11, 5, 3, 2, 20])] == [[], [], [], [], [[(4, 0, 16)]]]
    assert next(packer.full()) == [(0, 0, 11), (1, 0, 5)]
    assert list(packer.full()) == [[(4, 16, 4)], [(2, 0, 3), (3, 0, 1)]]
    assert list(packer.rest()) == [[(3, 1, 1)]]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([1, 2, 4, 8, 16]), max_size=300))
def test_step_groups_weigh_the_same(lengths):
    groups, held = packing.Groups(32), collections.Counter()
    for n in lengths:
        held[groups.place(n)] += n
    assert all(n <= 32 for n in held.values()) and len(held) == groups.made
    assert {g for g, n in held.items() if n < 32} == {g for _, g in groups.open}


def check(rows, docs, tokenizer, tiers):
    whole = lambda t: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
    sequences, groups, pieces = collections.defaultdict(list), collections.Counter(), collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == parts[0].window <= tiers[-1] and at & (at - 1) == 0
        groups[parts[0].step_group] += at
    ids = collections.defaultdict(list)
    for doc_id, text in docs:
        ids[doc_id].append(whole(text))
    assert set(pieces) == set(ids)
    for doc_id, texts in ids.items():
        assert sum(r.length for r in pieces[doc_id]) == sum(map(len, texts))
        for r in pieces[doc_id]:
            assert any(len(t) == r.doc_tokens and zlib.crc32(t[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for t in texts)
        if len(texts) == 1:
            at = 0
            for r in sorted(pieces[doc_id], key=lambda r: r.start):
                assert r.start == at
                at += r.length
    return groups


def test_messy_and_empty_tables(messy, messy_rows, no_docs, tokenizer_path):
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rows = packing.packed_rows(messy).collect()
    check(rows, [(d, t) for d, t, *_ in messy_rows], tokenizer, packing.TIERS)
    assert any(r.doc_tokens > 3 * 4096 for r in rows) and any(r.length == 4096 for r in rows)
    assert packing.packed_rows(no_docs).collect() == []


@pytest.mark.parametrize("step", [1 << 10, 1 << 20])
def test_given_table_in_small_steps(spark, small_folder, tokenizer_path, monkeypatch, step):
    monkeypatch.setattr(packing, "ENCODE_BYTES", step)
    docs = spark.read.parquet(f"{small_folder}/documents.parquet")
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rows = packing.packed_rows(docs).collect()
    groups = check(rows, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], tokenizer, packing.TIERS)
    assert sum(n == packing.STEP_TOKENS for n in groups.values()) >= 1
    cut = collections.Counter(r.doc_id for r in rows if r.doc_tokens < 4096)
    assert sum(n > 1 for n in cut.values()) < len(cut) / 2
