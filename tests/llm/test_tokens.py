"""Token files and token counts against the libraries."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from actilens.llm import rans, token_counts, token_files
from actilens.llm.common import work_path
from actilens.llm.tokenizing import PieceCounts, WordIds

ODD_TEXTS = [
    "", " ", "a  b", " lead", "trail ", "İstanbul ẞ ß Ǆ Σας ΟΔΟΣ", "don't they're I'LL x'd 'tis ''s", "a<|endoftext|>b <|startoftext|>",
    "é ́a\ńb", "日本語 テキスト 123 4５", "a\x1cb\x85c d e", "tab\there\r\nnew\x0b\x0c", "‘q’ “w” …a.b,c", "ﬁ Å K Ω x²³ ½ Ⅻ", "a_b __ ..!?.;",
    "AB.'s it's, 's.", "힣각 한국어", "a <s> b</s>c <unk> d", "▁ a▁b ▁", "_▁ ßs", "a\u00a0b c\u3000d", "x.Σ ΑΣ. Aσ,Σ", "a|b<|x a.|b", "word### x*** y!! (z)", "ÀÖØö÷×ÿĀ",
    "a ¨x y¨ z", "a\nb c\n d \ne", "x \u200b y\u200b z", "a ͺ ͺb cͺ", "p \ufdfa q", "e \u0308 f\u0308 g", "‗ x‗ y",
]


@pytest.fixture(scope="module")
def words(tokenizer_path):
    return WordIds(tokenizer_path("word_bpe_49k.json"), 1)


@pytest.fixture(scope="module")
def counter(tokenizer_path):
    return PieceCounts(tokenizer_path("piece_bpe_32k.model"))


def pieces_of(words, texts):
    ids, sizes = words.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(sizes)
    return [ids[e - n : e].tolist() for e, n in zip(ends, sizes)]


def test_pieces_give_the_ids_of_the_whole_text(words):
    whole = lambda t: words.tokenizer.encode(t, add_special_tokens=False).ids
    assert pieces_of(words, ODD_TEXTS) == [whole(t) + [1] for t in ODD_TEXTS]
    words.forget()
    assert pieces_of(words, ODD_TEXTS[::-1]) == [whole(t) + [1] for t in ODD_TEXTS[::-1]]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aBé'.s t<|>\n1_—ßĀ́▁\u00a0\u3000\u2009\tΣ,$")), max_size=25))
def test_any_text(words, counter, text):
    assert pieces_of(words, [text]) == [words.tokenizer.encode(text, add_special_tokens=False).ids + [1]]
    assert counter.counts(pa.array([text, None]))[0] == len(counter.model.encode(text))


def test_piece_counts_are_those_of_the_library(counter):
    assert counter.counts(pa.array(ODD_TEXTS)).tolist() == [len(counter.model.encode(t)) for t in ODD_TEXTS]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 5000, 400_000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    tokens = np.minimum(rng.zipf(1.3, n), 49_000).astype(np.uint32)
    tables = rans.Tables(rans.frequencies(np.bincount(tokens, minlength=10)))
    block = rans.encode(tokens, tables)
    assert (rans.decode(block, tables) == tokens).all()
    for first, stop in ((0, 1), (n // 2, n // 2 + 7), (n - 1, n), (n // 3, n)):
        if 0 <= first < stop <= n:
            assert (rans.decode(block, tables, first, stop) == tokens[first:stop]).all()


def test_coder_is_near_the_entropy_and_notices_damage():
    tokens = np.minimum(np.random.default_rng(1).zipf(1.5, 300_000), 20_000)
    counts = np.bincount(tokens)
    share = counts[counts > 0] / len(tokens)
    block = rans.encode(tokens, rans.Tables(rans.frequencies(counts)))
    assert len(block) * 8 < 1.03 * -(share * np.log2(share)).sum() * len(tokens) + 8 * 64 * rans.LANES * 4
    for at in (rans.HEAD_BYTES + 3, len(block) - 2):
        broken = bytearray(block)
        broken[at] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            rans.decode(bytes(broken), rans.Tables(rans.frequencies(counts)))


def test_frequencies_fill_the_slots_and_drop_nothing():
    rng = random.Random(1)
    for n in (1, 2, 1000, 60_000):
        counts = np.array([rng.choice([0, 1, 1, 5, 10**9]) for _ in range(n)] + [1])
        freq = rans.frequencies(counts)
        assert freq.sum() == 1 << rans.SCALE and ((freq > 0) == (counts > 0)).all()


def test_token_files(spark, messy, messy_rows, no_docs, words):
    got = token_files.written_rows(messy).orderBy("start").collect()
    assert len(got) == len(messy_rows)
    start, rest = 0, sorted(messy_rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for row, want in zip(got, rest):
        assert row.doc_id == want[0] and row.start == start
        texts = [t for d, t, *_ in messy_rows if d == row.doc_id]
        ids = [words.tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
        assert (row.n_tokens, row.ids_crc32) in {(len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for i in ids}
        start += row.n_tokens
    assert token_files.written_rows(no_docs).collect() == []


def test_blocks_decode_on_their_own(spark, messy, words, tokenizer_path):
    path = work_path(spark, "token-test")
    token_files.write(messy, path, tokenizer_path("word_bpe_49k.json"), block_tokens=500)
    docs = token_files.read(spark, path).orderBy("file", "block", "doc").collect()
    texts = {d: t for d, t in messy.select("doc_id", "text").collect()}
    for r in docs:
        if r.doc_id in (4, 6, 8, 12):
            assert np.frombuffer(r.ids, "<u4").tolist() == words.tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids + [1]
    blocks = spark.read.parquet(f"{path}/blocks")
    assert blocks.count() > 10 and blocks.where("n_docs > 1").agg(F.max("n_tokens")).first()[0] <= 500


def test_counts_and_cache(spark, messy, messy_rows, no_docs, counter, tokenizer_path):
    cache, model = work_path(spark, "count-test"), tokenizer_path("piece_bpe_32k.model")
    token_counts.update(no_docs, cache, model)
    part = messy.where("doc_id < 30")
    token_counts.update(part, cache, model)
    first = spark.read.parquet(cache).count()
    assert first == part.select(F.coalesce("text", F.lit(""))).distinct().count()
    got = token_counts.counts(messy, cache, model, limit=100).collect()
    want = [(d, len((t or "").encode()), n := len(counter.model.encode(t or "")), n > 100) for d, t, *_ in messy_rows]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    entries = spark.read.parquet(cache).count()
    assert entries == messy.select(F.coalesce("text", F.lit(""))).distinct().count()
    token_counts.update(messy, cache, model)  # nothing is missing now
    assert spark.read.parquet(cache).count() == entries
    other = spark.createDataFrame([(bytearray(32), "another tokenizer", 7)], token_counts.ENTRY)
    other.write.mode("append").parquet(cache)
    assert token_counts.counts(messy, cache, model).count() == len(messy_rows)
    assert token_counts.counts(no_docs, cache, model).count() == 0
