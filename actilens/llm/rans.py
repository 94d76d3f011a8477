"""Static range asymmetric numeral system over token ids, interleaved lanes, in numpy.

A block is coded on its own with a shared table of frequencies (total 2 ** SCALE). Token i belongs to lane i mod lanes;
all lanes take one step at a time. States are 64-bit in [2 ** 31, 2 ** 63), words of 32 bits move in and out. Every
``CHECK_STEPS`` steps the lane states and the place in the word stream are kept, so a reader can begin there.

Block layout, little-endian: 48-byte head (magic, version, lanes, tokens, words, checkpoints, step between checkpoints,
crc32 of all that follows), lane states of each checkpoint, word place of each checkpoint, words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE = 20
LANES = 1024
CHECK_STEPS = 128
MAGIC, VERSION = b"RTOK", 1
HEAD = "<4sIIIQQII8x"
HEAD_BYTES = struct.calcsize(HEAD)
LOW = np.uint64(1 << 31)
_WORD, _MASK = np.uint64(32), np.uint64(0xFFFFFFFF)


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a total of 2 ** SCALE; whatever occurs keeps at least 1."""
    total, seen = 1 << SCALE, counts > 0
    if seen.sum() > total:
        raise ValueError("more token ids than slots")
    if not seen.any():
        return np.zeros(len(counts), np.uint32)
    exact = counts / counts.sum() * total
    out = np.where(seen, np.maximum(1, np.floor(exact)), 0).astype(np.int64)
    off = total - int(out.sum())
    if off > 0:
        order = np.lexsort((np.arange(len(out)), -(exact - out)))
        order = order[seen[order]]
        out[order] += off // len(order)
        out[order[: off % len(order)]] += 1
    while off < 0:  # too many ones: take from the most frequent
        order = np.argsort(-out, kind="stable")[: max(1, min(-off, int((out > 1).sum())))]
        out[order] -= 1
        off += len(order)
    return out.astype(np.uint32)


class Tables:
    """Frequencies, their running sums, and the token of every slot."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.low = np.concatenate([[0], np.cumsum(freq, dtype=np.int64)[:-1]]).astype(np.uint64)
        self.token = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def __reduce__(self):
        return Tables, (self.freq.astype(np.uint32),)  # tasks get the frequencies and build the rest


def encode(tokens: np.ndarray, tables: Tables) -> bytes:
    n = len(tokens)
    if n and not tables.freq[tokens].all():
        raise ValueError("a token has no frequency")
    lanes = int(np.clip(n // 256, 1, LANES))
    count = -(-n // lanes)
    scale, top = np.uint64(SCALE), np.uint64(63 - SCALE)
    freq, low = tables.freq[tokens], tables.low[tokens]
    limit = freq << top
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    kept: list[np.ndarray] = []
    ends: list[int] = []
    sent = 0
    for step in range(count - 1, -1, -1):
        at, to = step * lanes, min(n, step * lanes + lanes)
        f, x = freq[at:to], state[: to - at]
        full = x >= limit[at:to]
        if full.any():
            out = (x[full] & _MASK).astype(np.uint32)
            words.append(out)
            sent += len(out)
            x = np.where(full, x >> _WORD, x)
        quotient, rest = np.divmod(x, f)
        state[: to - at] = (quotient << scale) + rest + low[at:to]
        if step % CHECK_STEPS == 0:
            kept.append(state.copy())
            ends.append(sent)
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    places = (sent - np.array(ends[::-1], np.int64)).astype("<u8")
    states = np.concatenate(kept[::-1]).astype("<u8") if kept else np.zeros(0, "<u8")
    body = states.tobytes() + places.tobytes() + stream.astype("<u4").tobytes()
    return struct.pack(HEAD, MAGIC, VERSION, lanes, len(kept), n, len(stream), CHECK_STEPS, zlib.crc32(body)) + body


def decode(block: bytes, tables: Tables, first: int = 0, stop: int | None = None) -> np.ndarray:
    """Tokens ``first`` to ``stop`` of a block, from the last checkpoint before ``first`` on."""
    magic, version, lanes, checkpoints, n, n_words, every, crc = struct.unpack_from(HEAD, block)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token block")
    if zlib.crc32(memoryview(block)[HEAD_BYTES :]) != crc:
        raise ValueError("token block is damaged")
    stop = n if stop is None else min(stop, n)
    if first >= stop:
        return np.zeros(0, np.uint32)
    states = np.frombuffer(block, "<u8", checkpoints * lanes, HEAD_BYTES).reshape(checkpoints, lanes)
    places = np.frombuffer(block, "<u8", checkpoints, HEAD_BYTES + states.nbytes)
    words = np.frombuffer(block, "<u4", n_words, HEAD_BYTES + states.nbytes + places.nbytes)
    begin = first // (lanes * every)
    state, at = states[begin].astype(np.uint64), int(places[begin])
    scale, slots = np.uint64(SCALE), np.uint64((1 << SCALE) - 1)
    start, end = begin * every, -(-stop // lanes)
    out = np.empty(min(n, end * lanes) - start * lanes, np.uint32)
    for step in range(start, end):
        size = min(lanes, n - step * lanes)
        x = state[:size]
        slot = x & slots
        token = tables.token[slot]
        x = tables.freq[token] * (x >> scale) + slot - tables.low[token]
        hungry = x < LOW
        need = int(hungry.sum())
        if need:
            x[hungry] = (x[hungry] << _WORD) | words[at : at + need]
            at += need
        state[:size] = x
        out[(step - start) * lanes :][:size] = token
    return out[first - start * lanes : stop - start * lanes]
