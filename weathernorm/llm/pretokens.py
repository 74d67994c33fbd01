"""Texts as words between blanks, and the ids of the distinct words of a slice of texts.

The vocabulary is a sentencepiece BPE model without a normaliser. No piece of it holds a blank after
another character (checked when the model is loaded), so merges never cross a blank, and the ids of a
text are those of what stands between its blanks, one after the other. So each distinct word of a
slice of texts is encoded once, all of them in one call of the library. Texts with runs of blanks, or
with one at an end, are given to the library whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARK = "▁"
#: Bytes of the texts that are taken apart at once: bounds what a task holds (a longer text is one slice).
SLICE_BYTES = 8 << 20
#: Ids that are put in order at once.
GATHERED = 1 << 20
#: Longer words are rare; no table or cache holds them.
LONGEST_KEPT = 48
#: Inside a piece: the mark of a blank after any other character.
_CROSSING = re.compile(f"[^{MARK}]{MARK}")
_loaded: dict[str, object] = {}


def model_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def processor(path: str):
    """The sentencepiece processor, loaded once per worker process."""
    if path not in _loaded:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        for i in range(sp.vocab_size()):
            if _CROSSING.search(sp.id_to_piece(i)):
                raise ValueError(f"piece {i} reaches over a blank: {sp.id_to_piece(i)!r}")
        if sp.normalize("ﬁ\xa0  　¨") != f"{MARK}ﬁ\xa0{MARK}{MARK}　¨":
            raise ValueError("the model changes texts before it cuts them")
        _loaded[path] = sp
    return _loaded[path]


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in order, in slices of about ``SLICE_BYTES``."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield texts.slice(start, stop - start)
        start = stop


class Words:
    """The words of some texts: ``distinct`` ones, the number (``which``) of each word in order, and where each
    text's words start (``starts``, and the end). NULL is an empty text, and one empty word; so are the texts
    that the library must take whole, which are in ``whole`` by their place."""

    def __init__(self, texts: pa.Array) -> None:
        texts = pc.fill_null(texts, "")
        if pc.any(pc.match_substring(texts, MARK)).as_py():
            texts = pc.replace_substring(texts, MARK, " ")
        spaced = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
        self.whole: dict[int, str] = {}
        if pc.any(spaced).as_py():
            at = np.flatnonzero(spaced.to_numpy(zero_copy_only=False))
            self.whole = dict(zip(at.tolist(), texts.take(pa.array(at)).to_pylist(), strict=True))
            texts = pc.if_else(spaced, "", texts)
        cut = pc.split_pattern(texts, " ")
        coded = cut.flatten().dictionary_encode()
        self.starts = cut.offsets.to_numpy()
        self.which, self.distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()

    def sums(self, each: np.ndarray) -> np.ndarray:
        """For each text, the sum of its words' values; ``each`` is by distinct word."""
        return np.add.reduceat(each[self.which], self.starts[:-1]) if len(self.starts) > 1 else np.zeros(0, np.int64)


class Encoder:
    """The ids, or the numbers of ids, of whole texts as the library gives them."""

    def __init__(self, path: str) -> None:
        self.sp = processor(path)
        self.dtype = np.dtype("<u2" if self.sp.vocab_size() <= 65536 else "<u4")

    def of(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        return self.sp.encode(words, num_threads=1) if words else []

    def ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for part in slices(texts):
            words = Words(part)
            encoded = self.of(words.distinct)
            size = np.fromiter(map(len, encoded), np.int64, len(encoded))
            flat = np.fromiter(chain.from_iterable(encoded), self.dtype, int(size.sum()))
            del encoded
            first, total = np.cumsum(size) - size, np.cumsum(words.sums(size))
            a = 0
            while a < len(part):  # texts of about GATHERED ids at once
                done = total[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(total, done + GATHERED, side="right")))
                which = words.which[words.starts[a] : words.starts[b]]
                n = size[which]
                at = np.repeat(first[which] - (np.cumsum(n) - n), n)
                at += np.arange(len(at))
                out = flat[at]
                for k, ids in enumerate(np.split(out, (total[a:b] - done)[:-1]), a):
                    yield np.array(self.sp.encode(words.whole[k]), self.dtype) if k in words.whole else ids
                a = b

    def lengths(self, texts: pa.Array, of_words: Callable[[list[str]], list[int]]) -> np.ndarray:
        """The number of ids of each text; ``of_words`` gives those of distinct words."""
        found = [np.zeros(0, np.int64)]
        for part in slices(texts):
            words = Words(part)
            n = words.sums(np.array(of_words(words.distinct), np.int64))
            for k, text in words.whole.items():
                n[k] = len(self.sp.encode(text))
            found.append(n)
        return np.concatenate(found)


class Lengths:
    """word -> number of ids, in two tiers: a table of frequent words, and this worker's cache of others, whose
    misses the library encodes in one call. The cache is emptied when it is full."""

    #: Entries of a worker's cache, some 150 bytes each.
    CACHE_ENTRIES = 150_000

    def __init__(self, encoder: Encoder, frequent: dict[str, int]) -> None:
        self.encoder, self.frequent, self.cache = encoder, frequent, {}

    def __call__(self, words: list[str]) -> list[int]:
        n = list(map(self.frequent.get, words))
        rest = [k for k, x in enumerate(n) if x is None]
        if rest:
            asked = [words[k] for k in rest]
            kept = list(map(self.cache.get, asked))
            missed = [w for w, x in zip(asked, kept, strict=True) if x is None]
            made = dict(zip(missed, map(len, self.encoder.of(missed)), strict=True))
            for k, w, x in zip(rest, asked, kept, strict=True):
                n[k] = made[w] if x is None else x
            if len(self.cache) + len(made) > self.CACHE_ENTRIES:
                self.cache.clear()
            room = self.CACHE_ENTRIES - len(self.cache)
            self.cache.update([(w, x) for w, x in made.items() if len(w) <= LONGEST_KEPT][:room])
        return n


_kept: dict[str, tuple[str, Lengths]] = {}


def lengths(path: str, table: str, frequent: dict[str, int]) -> tuple[Encoder, Lengths]:
    """This worker's encoder and lengths for one broadcast table; a new table replaces the old one."""
    if path not in _kept or _kept[path][0] != table:
        _kept.clear()
        _kept[path] = (table, Lengths(Encoder(path), frequent))
    return _kept[path][1].encoder, _kept[path][1]
