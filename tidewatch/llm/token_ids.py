"""Texts to token ids with the tokenizers library, one lookup per word that was met before.

Words of many texts are taken together: Arrow cuts the texts and finds the distinct words, only new ones go
to the library, and the ids of all words are put together by their places in one array.
"""

import os
import string
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of which a Python worker remembers the ids. Beyond it, it forgets all and starts again.
REMEMBERED = 1_200_000
#: Bytes of text that are encoded at a time; a longer text is one slice.
SLICE_BYTES = 16 << 20


def vocabulary(name: str) -> str:
    """The file of an installed public vocabulary on the machine that asks."""
    import public_tokenizers
    return public_tokenizers.path(name)


def slices(batch: pa.RecordBatch, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """`batch`, which has a column `text`, in parts of about `size` bytes (`SLICE_BYTES`)."""
    size = size or SLICE_BYTES
    before = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = np.unique(np.searchsorted(before, np.arange(size, before[-1] + size, size)) if len(before) else [])
    start = 0
    for end in [*(min(int(c) + 1, batch.num_rows) for c in cuts), batch.num_rows]:
        if end > start:
            yield batch.slice(start, end - start)
            start = end


_PUNCTUATION = string.punctuation
# All characters that any of the libraries takes for white space.
_SPACES = "\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_ODD = f"^ | $|[{_SPACES}] | [{_SPACES}]"
#: Letters that fold to one letter and do not combine with what follows.
_LETTERS = "[A-Za-z\\x{aa}\\x{b5}\\x{ba}\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{12f}]+"
_LINE = 1000


class Store:
    """Arrays of ids by row number."""

    def __init__(self):
        self.ids = np.zeros(1 << 16, dtype="<u4")
        self.starts = np.zeros((1 << 12) + 1, dtype=np.int64)
        self.rows = 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """The number of the first of the rows that are added."""
        first, used = self.rows, int(self.starts[self.rows])
        while used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + len(sizes) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[used:used + len(ids)] = ids
        self.rows += len(sizes)
        self.starts[first + 1:self.rows + 1] = used + np.cumsum(sizes)
        return first

    def sizes(self, rows: np.ndarray) -> np.ndarray:
        return self.starts[rows + 1] - self.starts[rows]

    def gather(self, rows: np.ndarray) -> np.ndarray:
        """The ids of the rows, one after another."""
        sizes = self.sizes(rows)
        shift = self.starts[rows] - (np.cumsum(sizes) - sizes)
        return self.ids[np.arange(sizes.sum()) + np.repeat(shift, sizes)]


class Encoder:
    """Encodes whole texts, word by word.

    The byte-level vocabulary does not join characters across a single space between two characters that are
    not white space; the other kind drops white space and joins nothing across it. So texts are cut there.
    A text that has other white space next to a space (byte-level only), or that names a special token, is
    encoded by the library in one piece.
    """

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(vocabulary(name))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        tokens = self.tokenizer.get_vocab(with_added_tokens=False)
        size = max(tokens.values()) + 1
        self.begins, self.ends = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
        for token, number in tokens.items():
            self.begins[number] = token.startswith("Ġ")
            self.ends[number] = token.endswith("</w>")
        self.byte_level = not self.ends.any()
        self._forget()

    def _forget(self) -> None:
        self.store = Store()
        #: Stems after a space, words at the start of a text, and punctuation after a stem.
        self.words: dict[str, int] = {}
        self.heads: dict[str, int] = {}
        self.tails: dict[str, int] = {}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text begins and the last one ends."""
        if len(self.words) + len(self.heads) > REMEMBERED:
            self._forget()
        whole = np.zeros(len(texts), dtype=bool)
        for name in self.special:
            whole |= _mask(pc.match_substring(texts, name, ignore_case=True))
        if self.byte_level:
            whole |= _mask(pc.match_substring_regex(texts, _ODD))
        if not whole.any():
            return self._by_words(texts)
        parts: list = [None] * len(texts)
        ids, ends = self._by_words(texts.filter(pa.array(~whole)))
        for i, (a, b) in zip(np.flatnonzero(~whole), zip(ends, ends[1:])):
            parts[i] = ids[a:b]
        at = np.flatnonzero(whole)
        for i, found in zip(at, self._library(texts.take(pa.array(at)).to_pylist())):
            parts[i] = np.array(found, dtype="<u4")
        return np.concatenate(parts), _ends([len(p) for p in parts])

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(texts, " ") if self.byte_level else pc.ascii_split_whitespace(texts)
        cuts, words = lists.offsets.to_numpy().astype(np.int64), lists.values
        coded = words.dictionary_encode()
        which = coded.indices.to_numpy().astype(np.int64)
        found = Store()  # the ids of the distinct words
        found.add(*self._words(coded.dictionary))
        if self.byte_level:  # every text has a first word, be it empty, that follows no space
            heads = words.take(pa.array(cuts[:-1]))
            rows = self._rows(heads, self.heads, self._library)
            which[cuts[:-1]] = found.add(self.store.gather(rows), self.store.sizes(rows)) + np.arange(len(rows))
        return found.gather(which), _ends(found.sizes(which))[cuts]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids and their number of distinct words after a space. Punctuation has ids of its own, after
        those of its word; and the kind of vocabulary that folds case has the same ids for words that
        differ in it alone. So what is remembered are stems and punctuation."""
        stems = pc.utf8_rtrim(words, characters=_PUNCTUATION)
        plain = pc.match_substring_regex(stems, f"^{_LETTERS}$")
        tails = pc.if_else(plain, pc.replace_substring_regex(words, f"^{_LETTERS}", ""), "")
        stems = pc.if_else(plain, stems if self.byte_level else pc.utf8_lower(stems), words)
        rows = np.stack([self._rows(stems, self.words, self._spaced),
                         self._rows(tails, self.tails, self._library)], axis=1)
        sizes = self.store.sizes(rows.ravel()).reshape(-1, 2).sum(axis=1)
        return self.store.gather(rows.ravel()), sizes

    def _rows(self, words: pa.Array, memory: dict[str, int], encode) -> np.ndarray:
        """The rows of the store that hold the words' ids; `encode` gives those of new ones."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        rows = np.fromiter((memory.get(w, -1) for w in distinct), dtype=np.int64, count=len(distinct))
        new = np.flatnonzero(rows < 0)
        if len(new):
            unknown = [distinct[i] for i in new]
            rows[new] = self._stored(encode(unknown))
            memory.update(zip(unknown, rows[new].tolist()))
        return rows[coded.indices.to_numpy()]

    def _stored(self, found: list[list[int]] | np.ndarray) -> np.ndarray:
        if isinstance(found, np.ndarray):
            return found
        ids = np.fromiter((i for one in found for i in one), dtype="<u4")
        return self.store.add(ids, np.array([len(one) for one in found])) + np.arange(len(found))

    def _spaced(self, words: list[str]) -> np.ndarray:
        """Rows of words after a space. They are encoded in lines, as the ids show where each begins; with
        the vocabulary that folds case only words of letters are."""
        rows = np.zeros(len(words), dtype=np.int64)
        fits = np.array([bool(w) if self.byte_level else w.isalpha() for w in words], dtype=bool)
        lined, single = np.flatnonzero(fits), np.flatnonzero(~fits)
        for at in range(0, len(lined), _LINE):
            part = lined[at:at + _LINE]
            ids = np.array(self._library([" " + " ".join([words[i] for i in part])])[0], dtype="<u4")
            cuts = (np.flatnonzero(self.begins[ids]) if self.byte_level else
                    np.concatenate([[0], np.flatnonzero(self.ends[ids])[:-1] + 1]))
            if len(cuts) == len(part):  # each word has one mark at least
                rows[part] = self.store.add(ids, np.diff(np.append(cuts, len(ids)))) + np.arange(len(part))
            else:
                single = np.concatenate([single, part])
        if len(single):
            rows[single] = self._stored(self._library([" " + words[i] if words[i] else "" for i in single]))
        return rows


def _mask(values) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(bool)


def _ends(sizes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


@lru_cache(maxsize=4)
def encoder(name: str) -> Encoder:
    """One per Python worker and vocabulary, so that its memory lasts from task to task."""
    return Encoder(name)


def with_end(ids: np.ndarray, ends: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """`encode`'s result with the id `end` after each text."""
    return np.insert(ids, ends[1:], np.uint32(end)), ends + np.arange(len(ends))


def crc32(ids: np.ndarray) -> int:
    """Of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").data)
