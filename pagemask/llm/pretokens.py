"""Whitespace-delimited words of plain Latin text, on which token caches work.

Where a text is Latin-1 without unusual control or space characters, and no two white-space characters meet, the pattern
of byte-level tokenizers never crosses a space or line break: '<text of a line>' splits into its first word, then ' word'
for each further one, and each line break is a piece of its own. So a cache from such words to ids gives what the library
gives for the whole text. Any other text goes to the library (or the pattern) whole.

Words are told apart by an Arrow dictionary of a portion of texts: each distinct word is looked up once a portion, and the values
are gathered for all its places at once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of Latin-1 whose classes (letter, number, space) are the same in every Unicode version and regex library.
PLAIN = bytes([10, *range(32, 127), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]) + b"\xa1\xa7\xab\xb0\xb4\xb7\xbb\xbf"
#: Marks the first word of a text; no plain text holds it.
FIRST = "\0"


def plain(text: str) -> bool:
    """Whether every character of the text is one of PLAIN."""
    try:
        return not text.encode("latin-1").translate(None, PLAIN)
    except UnicodeEncodeError:
        return False


def single_spaced(text: str) -> bool:
    """Whether a text is plain, no two white-space characters meet, and no space stands at either end."""
    return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " ") and plain(text)


def piece(word: str) -> str:
    """The text that a word of `split` stands for: with its space or line break, or as the first of a text."""
    return word[1:] if word[0] == FIRST else word if word[0] == "\n" else " " + word


def split(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of single-spaced texts, the number of the word at each place, and where each text's places end."""
    parts = pc.split_pattern(pa.array([FIRST + t.replace("\n", " \n") for t in texts], pa.string()), " ")
    coded = parts.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), parts.offsets.to_numpy()[1:]


class Cache(dict):
    """A dictionary that computes what it misses. It holds two generations of `most` / 2 entries: what is used again stays."""

    def __init__(self, compute=None, most: int = 600_000):
        super().__init__()
        self.compute, self.most, self.old = compute, most // 2, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def all_of(self, keys: list, compute: Callable[[list], list]) -> list:
        """The values of distinct keys; compute gives those of all that aren't held, at once."""
        values = list(map(self.get, keys))
        missed = [i for i, v in enumerate(values) if v is None]
        old, new = self.old.get, []
        for i in missed:
            if (v := old(keys[i])) is None:
                new.append(i)
            else:
                values[i] = v
        for i, v in zip(new, compute([keys[i] for i in new]) if new else ()):
            values[i] = v
        for i in missed:
            self.put(keys[i], values[i])
        return values


def gathered(values: list[bytes], places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the values at all places one after the other, as uint32; and where each place's end, with a 0 in front."""
    taken = pa.array(values, pa.binary()).take(pa.array(places))
    _, ends, data = taken.buffers()
    return np.frombuffer(data or b"", np.uint32), np.frombuffer(ends, np.int32, len(taken) + 1, 4 * taken.offset) // 4


def encoded(texts: list[str], fits: Callable[[str], bool], words: Callable[[list[str]], list[bytes]], whole: Callable[[str], bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids (uint32) of all texts one after the other, and where each text's end.

    words gives the ids of distinct words of `split` as bytes; texts that don't fit go to `whole`.
    """
    fit = list(map(fits, texts))
    some = [t for t, f in zip(texts, fit) if f]
    if some:
        distinct, places, last = split(some)
        ids, ends = gathered(words(distinct), places)
        ends = ends[last]
    else:
        ids, ends = np.zeros(0, np.uint32), np.zeros(0, np.int32)
    if len(some) == len(texts):
        return ids, ends.astype(np.int64)
    out, sizes, own = [], [], zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())
    for t, f in zip(texts, fit):
        if f:
            a, b = next(own)
            out.append(ids[a:b])
        else:
            out.append(np.frombuffer(whole(t), np.uint32))
        sizes.append(len(out[-1]))
    return np.concatenate(out), np.cumsum(sizes, dtype=np.int64)
