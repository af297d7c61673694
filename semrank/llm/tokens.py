"""Token ids of the public tokenizers' library, with a bounded cache of the parts that it encodes alone.

A pre-token is encoded alone in every text, so its ids are looked up after the first time. The split into pre-tokens is done
here only for texts of ASCII and precomposed Latin letters, whose classes all Unicode versions agree on. Of other texts, the
vocabulary with word ends drops white space before anything else, so there the parts lie between two white spaces; the
byte-level one gets them whole. Every id comes from the library.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

#: Letters of U+00C0..U+024F but U+0130, whose lower case is two characters.
_LATIN = "À-ÖØ-öø-įı-ɏ"
_SAFE = re.compile(f"[\\t\\n\\r\\x20-\\x7E{_LATIN}]*")

# The split patterns of the two vocabularies, over the safe characters.
_SPLIT = {
    "byte_bpe_50k.json": f"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z{_LATIN}]+| ?[0-9]+| ?[^\\sA-Za-z0-9{_LATIN}]+|\\s+(?!\\S)|\\s+",
    "word_bpe_49k.json": f"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z{_LATIN}]+|[0-9]|[^\\sA-Za-z0-9{_LATIN}]+",
}


class Encoder:
    """Of one worker. The cache has two generations of `max_cached` parts of `longest` characters: when the young one is full
    it becomes the old one, and what is used again comes back.
    """

    def __init__(self, path: str, max_cached: int = 400_000, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        name = os.path.basename(path)
        self.split = re.compile(_SPLIT[name]).findall if name in _SPLIT else None
        self.word_ends = name == "word_bpe_49k.json"
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.wide = self.library.get_vocab_size() > 1 << 16
        self.max_cached, self.longest = max_cached, longest
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.last = np.zeros(self.library.get_vocab_size() + 1, dtype=bool)
        if self.word_ends:
            for token, at in self.library.get_vocab().items():
                self.last[at] = token.endswith("</w>")

    @property
    def dtype(self):
        return np.uint32 if self.wide else np.uint16

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Of pre-tokens whose last id ends a word, encoded as one text."""
        ids = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype=self.dtype)
        ends = ((np.flatnonzero(self.last[ids]) + 1) * ids.itemsize).tolist()
        if len(ends) != len(words):
            return self._library(words)
        raw = ids.tobytes()
        return [raw[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]

    def simple(self, text: str) -> bool:
        return self.split is not None and _SAFE.fullmatch(text) is not None and not ("<" in text and any(s in text for s in self.special))

    def _learn(self, lists: list[list[str]], encode) -> list[str]:
        """Puts what isn't cached into the cache; the parts that are too long to stay there."""
        new = list(set().union(*lists) - self.cache.keys())
        again = {x: self.old[x] for x in new if x in self.old}
        if again:
            self.cache.update(again)
            new = [x for x in new if x not in again]
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            self.cache.update(zip(some, encode(some), strict=True))
        return [x for x in new if len(x) > self.longest]

    def trim(self) -> None:
        """At the end of a task: the old generation goes, so that an idle worker holds one at most."""
        self.old = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian bytes of dtype."""
        if len(self.cache) > self.max_cached:
            self.cache, self.old = {}, self.cache
        split, white, whole = {}, {}, []
        for i, t in enumerate(texts):
            if self.simple(t):
                split[i] = self.split(t.lower() if self.word_ends else t)
            elif self.word_ends and not any(c in t for c in "\x1c\x1d\x1e\x1f"):  # white space to str.split(), not to the library
                white[i] = t.split()
            else:
                whole.append(i)
        out: list = [None] * len(texts)
        for lists, encode in ((white, self._library), (split, self._words if self.word_ends else self._library)):
            long = self._learn(list(lists.values()), encode)
            for i, parts in lists.items():
                out[i] = b"".join(map(self.cache.__getitem__, parts))
            for part in long:
                del self.cache[part]
        for i, found in zip(whole, self._library([texts[i] for i in whole]), strict=True):
            out[i] = found
        return out


def groups(texts: list, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(first, end) of consecutive texts of about `size` characters."""
    lo = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size or i - lo >= 1 << 14 or i == len(texts) - 1:
            yield lo, i + 1
            lo, total = i + 1, 0


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def at_spaces(text: str, size: int) -> Iterator[str]:
    """text in parts that end at white space, of about `size` characters."""
    at = 0
    while len(text) - at > 2 * size:
        m = _SPACE.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


_SPACE = re.compile(r"[ \t\n\r]")
