"""Encoding with public tokenizers inside tasks, with the pieces of texts remembered by the worker."""

from __future__ import annotations

import os
import re
import string
import unicodedata
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from actilens.llm.common import ranges, worker_state

#: Pieces that a worker remembers before it drops the rare ones; each takes about 200 bytes.
REMEMBERED = 300_000
#: A run of these letters is one pre-token; an ASCII mark behind it begins the next. The apostrophe may belong to a
#: shortened word and the bar to an added token, so they stay with the letters.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = string.punctuation.replace("'", "").replace("|", "")
MARK_BEHIND = f"([{LETTERS}])([{re.escape(MARKS)}])"


def distinct_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct pieces between single spaces, which one stands at each place, and the number of pieces of each text."""
    lists = pc.split_pattern(texts, " ")
    coded = lists.flatten().dictionary_encode()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts


class WordIds(dict):
    """Ids of the pieces between blanks, for a ``tokenizers`` file whose pre-tokenizer drops white space.

    No token of such a tokenizer spans a blank, so the ids of a text are those of its pieces one after the other. Marks
    behind a letter are pieces of their own. A piece goes through the library once while it is remembered: the model alone
    for a run of Latin letters, else normaliser, pre-tokenizer and model, or the whole ``encode`` if it could hold an added
    token.
    """

    def __init__(self, path: str, end_id: int | None):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.normalizer, self.splitter = self.tokenizer.model, self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if [i for t in ("a b", "a  b") for i in self._whole(t)] != [*self._whole("a"), *self._whole("b")] * 2:
            raise ValueError("this tokenizer does not drop white space")
        self.end_id = end_id
        # A run of these letters is one pre-token, and each letter goes through the normaliser and splitter on its own.
        plain = re.compile(f"[{LETTERS}]").fullmatch
        alone = {c: self.splitter.pre_tokenize_str(self.normalizer.normalize_str(chr(c))) for c in range(65, 256) if plain(chr(c))}
        if any(len(parts) != 1 for parts in alone.values()):
            raise ValueError("this tokenizer splits letters")
        self.coded = {c: parts[0][0] for c, parts in alone.items()}
        if any(len(self._parts(f"a{m}")) != 2 for m in MARKS):
            raise ValueError("this tokenizer joins letters and marks")
        self.sizes, self.starts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.uses, self.fresh = np.zeros(0, np.int64), []

    def forget(self, wanted: int = 0) -> None:
        """Keep at most ``wanted`` pieces, those that most steps had."""
        least = 2
        while (self.uses >= least).sum() > wanted:
            least += 1
        stay = np.flatnonzero(self.uses >= least) if wanted else np.zeros(0, np.int64)
        names = list(self)  # in the order of their numbers
        kept = [names[k] for k in stay.tolist()]
        self.clear()
        self.update(zip(kept, range(len(kept))))
        sizes = self.sizes[stay]
        self.flat = self.flat[np.repeat(self.starts[stay], sizes) + ranges(sizes)]
        self.sizes, self.starts, self.uses = sizes, np.cumsum(sizes) - sizes, self.uses[stay] // 2
        self.fresh: list[list[int]] = []

    def _keep(self) -> None:
        """Move the ids found since the last call into the arrays."""
        sizes = np.fromiter(map(len, self.fresh), np.int64, len(self.fresh))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.uses = np.concatenate([self.uses, np.zeros(len(sizes), np.int64)])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(self.fresh), np.uint32, int(sizes.sum()))])
        self.fresh = []

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _parts(self, piece: str) -> list[str]:
        return [p for p, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(piece))]

    def _ids(self, piece: str) -> list[int]:
        if any(a in piece for a in self.added):
            return self._whole(piece)
        return [t.id for p in self._parts(piece) for t in self.model.tokenize(p)]

    def _learn(self, kinds: pa.Array) -> None:
        """Remember the ids of pieces that are new."""
        tokenize, coded = self.model.tokenize, self.coded
        plain = pc.match_substring_regex(kinds, f"^[{LETTERS}]+$").to_pylist()
        names = kinds.to_pylist()
        self.fresh = [[t.id for t in tokenize(n.translate(coded))] if p else self._ids(n) if n else [] for n, p in zip(names, plain)]
        self.update(zip(names, range(len(self.sizes), len(self.sizes) + len(names))))
        self._keep()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id behind it, and the number of ids of each text."""
        if len(self) > REMEMBERED:
            self.forget(REMEMBERED // 2)
        if None not in self:
            self.fresh = [[] if self.end_id is None else [self.end_id]]
            self[None] = len(self.sizes)
            self._keep()
        texts = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        kinds, piece, counts = distinct_pieces(pc.replace_substring_regex(texts, MARK_BEHIND, r"\1 \2"))
        known = np.fromiter(map(self.get, kinds.to_pylist(), repeat(-1)), np.int64, len(kinds))
        new = np.flatnonzero(known < 0)
        if len(new):
            known[new] = np.arange(len(self.sizes), len(self.sizes) + len(new))
            self._learn(kinds.take(pa.array(new)))
        place = np.insert(known[piece], np.cumsum(counts), self[None])
        self.uses[known] += 1
        sizes = self.sizes[place]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[place] - (ends - sizes), sizes)
        at += np.arange(len(at))
        return self.flat[at], np.diff(ends[np.cumsum(counts + 1) - 1], prepend=0)


@lru_cache
def id_type(path: str) -> str:
    """The narrowest little-endian number that holds every id of a tokenizer file."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def word_ids(path: str, end_id: int | None = None) -> WordIds:
    """The worker's encoder for a tokenizer file."""
    return worker_state(("word ids", path, end_id), lambda: WordIds(path, end_id))


def joining() -> str:
    """A pattern for pieces whose first or last character is the space mark or a blank, is dropped, or is normalised to something
    that begins or ends with a blank (all of these lie in the first plane)."""
    normal = ((c, unicodedata.normalize("NFKC", c)) for c in map(chr, (*range(0x21, 0xD800), *range(0xE000, 0x10000))))
    blank = "".join(f"\\x{{{ord(c):X}}}" for c, n in normal if (n[0] + n[-1]).strip(" ▁") != n[0] + n[-1])
    edge = rf"[\x00-\x20\x7F-\xA0\p{{Z}}\p{{C}}{blank}]"
    return rf"\A{edge}|{edge}\z"


class PieceCounts(dict):
    """Number of tokens of the pieces between single spaces, for a ``sentencepiece`` model.

    The library turns each space into a mark that can only begin a token, and puts one before the text, so pieces between
    single spaces are counted on their own. That is checked on the vocabulary; a text with other runs of spaces, or with
    the mark or another blank beside a space, could have tokens of several marks and goes through the library whole.
    """

    def __init__(self, path: str):
        super().__init__()
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        inner = (self.model.id_to_piece(i).lstrip("▁") for i in range(self.model.get_piece_size()))
        self.joining = joining()
        self.separate = not any("▁" in p for p in inner) and len(self.model.encode("a b")) == sum(map(len, self.model.encode(["a", "b"])))

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self.model.encode(piece))
        return n

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of tokens of each text."""
        if len(self) > REMEMBERED:
            self.clear()
        texts = pc.fill_null(texts, "")
        kinds, piece, sizes = distinct_pieces(texts)
        # A mark at the end of a piece, or a blank that the normaliser may turn into one, can join with the space.
        whole = pc.or_(pc.equal(kinds, ""), pc.match_substring_regex(kinds, self.joining)).to_numpy(zero_copy_only=False)
        blank = whole | (not self.separate)
        known = np.array([0 if b else self[k] for k, b in zip(kinds.to_pylist(), blank.tolist())], np.int64)
        first = np.cumsum(sizes) - sizes
        total = np.add.reduceat(known[piece], first) if len(piece) else np.zeros(len(sizes), np.int64)
        for row in np.flatnonzero(np.add.reduceat(blank[piece], first)).tolist() if len(piece) else ():
            total[row] = len(self.model.encode(texts[row].as_py()))
        return total


def piece_counts(path: str) -> PieceCounts:
    """The worker's counter for a model file."""
    return worker_state(("piece counts", path), lambda: PieceCounts(path))
