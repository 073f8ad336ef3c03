"""Remembered encodings of words: numbers in a dictionary, ids one after another in arrays."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` at ``starts``, one after another."""
    ends = sizes.cumsum()
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Remembered(defaultdict):
    """Words and their numbers; the ids of word n are ``flat[bounds[n]:bounds[n + 1]]``.

    ``encode_words`` gives the ids of new words: a list for each, or all in one array and how many each has. Beyond ``most`` words all are forgotten.
    """

    def __init__(self, encode_words: Callable[[list[str]], list[list[int]] | tuple[np.ndarray, np.ndarray]], most: int) -> None:
        self.encode_words, self.most = encode_words, most
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.default_factory = count().__next__
        self.flat, self.used = np.zeros(1 << 16, dtype="<u4"), 0
        self.bounds, self.known = np.zeros(1 << 16, dtype=np.int64), 0

    def learn(self) -> None:
        """Encode the words that have got a number since the last time."""
        new = self.encode_words(list(islice(reversed(self), len(self) - self.known))[::-1])
        if isinstance(new, tuple):
            flat, sizes = new
        else:
            sizes = np.fromiter(map(len, new), np.int64, len(new))
            flat = np.fromiter(chain.from_iterable(new), "<u4", int(sizes.sum()))
        ends = self.used + sizes.cumsum()
        while ends[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.known + len(sizes) + 1 > len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        self.flat[self.used : ends[-1]] = flat
        self.bounds[self.known + 1 : self.known + 1 + len(sizes)] = ends
        self.used, self.known = int(ends[-1]), self.known + len(sizes)

    def places(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each of ``words`` start in ``flat``, and how many they are."""
        if len(self) > self.most:
            self.forget()
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if len(self) > self.known:
            self.learn()
        starts = self.bounds[numbers]
        return starts, self.bounds[numbers + 1] - starts

    def flat_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``words`` one after another, and how many each has."""
        starts, sizes = self.places(words)
        return gathered(self.flat, starts, sizes), sizes

    def text_ids(self, texts: list[str | None]) -> Iterator[np.ndarray | None]:
        """The ids of each text (None stays None), cut into words at ASCII white space; each different word is looked up once."""
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        words = lists.flatten().dictionary_encode()
        starts, sizes = self.places(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        at = words.indices.to_numpy()
        flat = gathered(self.flat, starts[at], sizes[at])
        ends = np.append(0, sizes[at].cumsum())[np.append(0, pc.fill_null(lists.value_lengths(), 0).to_numpy().cumsum())].tolist()
        for text, i, j in zip(texts, ends, ends[1:], strict=False):
            yield None if text is None else flat[i:j]

    def ids(self, texts: list[list[str] | None]) -> Iterator[np.ndarray | None]:
        """The ids of each text, given as its words (None stays None)."""
        if len(self) > self.most:
            self.forget()
        numbers = [None if x is None else np.fromiter(map(self.__getitem__, x), np.int64, len(x)) for x in texts]
        if len(self) > self.known:
            self.learn()
        for n in numbers:
            if n is None:
                yield None
            else:
                starts = self.bounds[n]
                yield gathered(self.flat, starts, self.bounds[n + 1] - starts)


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches whose texts in ``column`` have about ``size`` bytes; a longer text is a slice of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        ends, begin = np.cumsum(sizes), 0
        while begin < len(ends):
            before = int(ends[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end
