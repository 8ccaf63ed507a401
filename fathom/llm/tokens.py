"""Token ids of whole texts, one tokenizer call for each distinct piece instead of each occurrence.

Both byte-pair vocabularies split a text into pieces first and encode every piece by itself, and no piece
reaches across white space (but for one space before a word).  So a text's ids are its chunks' ids in a
row, a chunk being what stands between spaces (with the space before it, where the vocabulary keeps
it) or a run of white space; and a chunk's ids are its pieces'.  A full stop or comma after a letter or a
number begins a piece, and a line end between other characters is one, so texts are cut there as well.  For
texts within a set of plain Latin code points, where the splitting rules are a fixed expression, Arrow cuts
a lot of texts and numbers its distinct chunks; each of these is looked up once a lot, and each new piece is
encoded by the tokenizers library.  Chunks are remembered in bounded caches, which a Python worker keeps from
task to task.  Any other text goes to the library whole, and so does one that holds the string of a token
added to the vocabulary, which the library finds before it splits.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from fathom.llm.common import kept_in_worker, release_worker_memory

#: Code points below this, but for the ones listed, take the fast way: a capital whose lower case is two
#: code points, and separators on which Python and the vocabularies disagree.
_PLAIN_END = 0x180
_NOT_PLAIN = f"[^\x00-\x1b\x20-\u012f\u0131-{chr(_PLAIN_END - 1)}]"
#: Distinct chunks remembered before those met only once are forgotten: fewer where case is dropped.
CACHE_CHUNKS, CACHE_CHUNKS_LOWER = 1_100_000, 500_000
#: Distinct pieces remembered before their cache starts afresh.
CACHE_PIECES, CACHE_PIECES_LOWER = 700_000, 300_000
#: Chunks whose ids are put together at once, if they are of several texts.
_GATHERED = 1 << 18
#: Bytes of Arrow batches that are encoded together.
LOT_BYTES = 16 << 20
#: Space before a word belongs to the word; other white space leaves its last character to what follows.
_SPACED = re.compile(r" ?\S+|\s+(?!\S)|\s+")

#: Where no space stands before other white space, texts can be split at their spaces: a chunk then means
#: itself with a space before it.  Other chunks carry a mark that no plain text has.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0"
_SPACE_BEFORE_SPACE = f" [{_WHITE}]| \\z"
_AS_IT_IS = "\x1f"


def _class(test) -> str:
    return "".join(re.escape(chr(c)) for c in range(_PLAIN_END) if test(chr(c)))


_LETTER = _class(lambda c: unicodedata.category(c)[0] == "L")
_NUMBER = _class(lambda c: unicodedata.category(c)[0] == "N")
_SPACE = _class(str.isspace)
#: Where one of these is found, a full stop, a comma or a line end may be part of a longer piece.
_NOT_CUT = f"[^{_LETTER}{_NUMBER}][.,]|\n[{_WHITE}]|[{_WHITE}]\n"
_SUFFIX = "'s|'t|'re|'ve|'m|'ll|'d"
#: The vocabularies' own splitting rules, for plain code points.
_BYTE_PIECES = re.compile(f"{_SUFFIX}| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_WORD_PIECES = re.compile(f"{_SUFFIX}|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")


def _byte_signs() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: a printable one for itself, others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in shown else next(others)) for b in range(256)]


_BYTE_SIGNS = _byte_signs()


class _Numbers(dict):
    """Numbers chunks in the order in which they are first asked for, and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = number = len(self)
        self.new.append(chunk)
        return number


class _Store:
    """Ids of numbered strings, one after the other."""

    def __init__(self):
        self.number = _Numbers()
        self._starts: list[np.ndarray] = [np.zeros(1, dtype=np.int64)]
        self._ids: list[np.ndarray] = []

    def numbers(self, strings: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, strings), dtype=np.int64, count=len(strings))

    def add(self, sizes: np.ndarray, ids: np.ndarray) -> None:
        self._starts.append(self._starts[-1][-1] + np.cumsum(sizes))
        self._ids.append(ids)

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the strings in a row, and where each string's end."""
        if len(self._starts) > 1:
            self._starts = [np.concatenate(self._starts)]
            self._ids = [np.concatenate(self._ids)]
        starts, ids = self._starts[0], self._ids[0] if self._ids else np.zeros(0, dtype=np.uint32)
        return _gathered(ids, starts, which)


def _gathered(ids: np.ndarray, starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = starts[which]
    size = starts[which + 1] - first
    after = np.cumsum(size)
    return ids[np.repeat(first - (after - size), size) + np.arange(int(after[-1]) if len(after) else 0)], after


class Encoder:
    """``encode(texts)`` gives each text's ids (uint32); the vocabulary file is a parameter."""

    def __init__(self, path: str, remembered: int | None = None):
        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: What the added tokens' strings have in common, up to the first letter: a quick test before the exact one.
        self.added_mark = re.match(r"[^\w\s]*", os.path.commonprefix(added))[0]
        self.added = re.compile("|".join(map(re.escape, added)) if added else "(?!)", re.IGNORECASE)
        #: A vocabulary that normalises drops white space and letter case.
        self.drops_space = self.tokenizer.normalizer is not None
        self.pieces = _WORD_PIECES if self.drops_space else _BYTE_PIECES
        self.model = self.tokenizer.model
        self.piece = _Store()
        #: Distinct chunks and pieces remembered.
        self.limits = (CACHE_CHUNKS_LOWER, CACHE_PIECES_LOWER) if self.drops_space else (CACHE_CHUNKS, CACHE_PIECES)
        if remembered:
            self.limits = tuple(min(remembered, x) for x in self.limits)
        self._forget()

    def _forget(self, keep: np.ndarray | None = None) -> None:
        """Start afresh, but for the numbers in ``keep`` (ascending)."""
        if keep is None:
            self.number = _Numbers()
            self.starts = np.zeros(1, dtype=np.int64)
            self.ids = np.zeros(0, dtype=np.uint32)
            self.met = np.zeros(0, dtype=np.int64)
            return
        names = list(self.number)
        self.ids, after = _gathered(self.ids, self.starts, keep)
        self.starts = np.concatenate(([0], after))
        self.number = _Numbers()
        self.number.update((names[k], at) for at, k in enumerate(keep.tolist()))
        self.met = self.met[keep] // 2

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has, and all of them in a row.  A piece is normalised and split already: the
        library's model merges it, without what a whole encoding carries."""
        tokenize = self.model.tokenize
        sizes, ids = [], []
        for piece in pieces:
            if piece.isascii() and piece.isprintable():
                piece = piece.replace(" ", _BYTE_SIGNS[32])
            else:
                piece = piece.encode().decode("latin-1").translate(_BYTE_SIGNS)
            got = tokenize(piece)
            sizes.append(len(got))
            ids += [token.id for token in got]
        return np.array(sizes, dtype=np.int64), np.array(ids, dtype=np.uint32)

    def _learn(self) -> None:
        """Encode the new chunks: words as they are, others put together from their pieces."""
        if len(self.piece.number) > self.limits[1]:
            self.piece = _Store()
        new = self.number.new
        words = [chunk.isalpha() for chunk in new]
        before = "" if self.drops_space else " "
        split, counts = [], []
        for chunk, is_word in zip(new, words, strict=True):
            if not is_word:
                if before:
                    chunk = chunk[1:] if chunk[:1] == _AS_IT_IS else before + chunk
                found = self.pieces.findall(chunk)
                split += found
                counts.append(len(found))
        which = self.piece.numbers(split)
        self.piece.add(*self._encoded(self.piece.number.new))
        self.piece.number.new.clear()
        ids, after = self.piece.gather(which)
        other_ends = np.concatenate(([0], after))[np.cumsum(np.array(counts, dtype=np.int64))]
        sizes, own = self._encoded([before + chunk for chunk, is_word in zip(new, words, strict=True) if is_word])
        # Words first, then the others, each then taken in the order of its number.
        starts = np.concatenate(([0], np.cumsum(sizes), len(own) + other_ends))
        is_word = np.array(words, dtype=bool)
        place = np.where(is_word, np.cumsum(is_word) - 1, int(is_word.sum()) + np.cumsum(~is_word) - 1)
        ids, after = _gathered(np.concatenate([own, ids]), starts, place)
        self.starts = np.concatenate([self.starts, self.starts[-1] + after])
        self.ids = np.concatenate([self.ids, ids])
        new.clear()

    def _numbered(self, chunks: list[str], times: np.ndarray | int) -> np.ndarray:
        """The numbers of distinct chunks, all learned, each met so many times more."""
        which = np.fromiter(map(self.number.__getitem__, chunks), dtype=np.int64, count=len(chunks))
        if self.number.new:
            self._learn()
        if len(self.met) < len(self.number):
            self.met = np.concatenate([self.met, np.zeros(len(self.number) * 3 // 2 + 1000 - len(self.met), dtype=np.int64)])
        self.met[which] += times
        return which

    def _chunks(self, texts: pa.Array) -> pa.Array:
        """A list of chunks for each text; empty ones mean nothing or a mark alone."""
        mark = "" if self.drops_space else _AS_IT_IS
        uncut = pc.match_substring_regex(texts, _NOT_CUT)
        if self.drops_space:
            texts = pc.utf8_lower(texts)
        cut = texts
        for sign, apart in ((",", f" {mark},"), (".", f" {mark}."), ("\n", f" {mark}\n {mark}")):
            cut = pc.replace_substring(cut, sign, apart)
        texts = pc.if_else(uncut, texts, cut)
        if self.drops_space:
            return pc.utf8_split_whitespace(texts)
        return pc.split_pattern(pc.binary_join_element_wise(pa.scalar(mark, texts.type), texts, pa.scalar("", texts.type)), " ")

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """Each text's ids; nulls are empty."""
        texts = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        if not len(texts):
            return []
        limit = self.limits[0]
        if len(self.number) > limit:
            often = np.flatnonzero(self.met[: len(self.number)] > 1)
            self._forget(often if len(often) <= limit // 2 else np.sort(often[np.argsort(-self.met[often], kind="stable")[: limit // 2]]))
        whole = _found(pc.match_substring_regex(texts, _NOT_PLAIN))
        for k in np.flatnonzero(_found(pc.match_substring(texts, self.added_mark)) & ~whole).tolist():
            whole[k] = self.added.search(texts[k].as_py()) is not None
        spaced = ~whole & (not self.drops_space)
        if spaced.any():
            spaced &= _found(pc.match_substring_regex(texts, _SPACE_BEFORE_SPACE))
        chunks = self._chunks(pc.if_else(pa.array(whole | spaced), pa.scalar("", texts.type), texts))
        cuts = chunks.offsets.to_numpy()
        numbered = pc.dictionary_encode(chunks.values)
        del chunks
        places = numbered.indices.to_numpy()
        which = self._numbered(numbered.dictionary.to_pylist(), np.bincount(places, minlength=len(numbered.dictionary)))
        out: list[np.ndarray] = []
        edges = np.unique(np.append(np.searchsorted(cuts, np.arange(0, cuts[-1], _GATHERED)), [0, len(texts)]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            ids, after = _gathered(self.ids, self.starts, which[places[cuts[a] : cuts[b]]])
            out += np.split(ids, np.concatenate(([0], after))[cuts[a + 1 : b] - cuts[a]])
        for k in np.flatnonzero(spaced).tolist():
            own = [_AS_IT_IS + chunk for chunk in _SPACED.findall(texts[k].as_py())]
            distinct = dict.fromkeys(own)
            number = dict(zip(distinct, self._numbered(list(distinct), 1).tolist(), strict=True))
            out[k] = _gathered(self.ids, self.starts, np.array([number[c] for c in own], dtype=np.int64))[0]
        for k in np.flatnonzero(whole).tolist():
            out[k] = np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, dtype=np.uint32)
        return out


def _found(answers: pa.Array) -> np.ndarray:
    return np.array(answers.to_numpy(zero_copy_only=False), dtype=bool)


@functools.lru_cache(maxsize=1)
def _encoder(path: str, remembered: int | None) -> Encoder:
    return Encoder(path, remembered)


kept_in_worker(_encoder.cache_clear)


def encoder(path: str, remembered: int | None = None) -> Encoder:
    """The worker's encoder for a vocabulary file, with what it has learned in earlier tasks.

    ``remembered`` bounds its caches where memory is short; fewer cost time and change no id.
    """
    release_worker_memory(keep=_encoder.cache_clear)
    return _encoder(path, remembered)


def lots(batches, size: int = LOT_BYTES):
    """Arrow batches put together to about ``size`` bytes: the larger a lot, the fewer look-ups of its chunks."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)
