"""BPE encoding of whole texts through the ``tokenizers`` library, one
library call per distinct word.

The vocabulary's pipeline is: NFC, white space to one space, lower case,
split into words by a fixed pattern, BPE per word.  BPE never crosses a
word, so a text's ids are its words' ids in order.  Plain Latin texts are
split by an equal ``re`` pattern; any other text is normalised and split by
the library itself, and texts holding a special token's string are first
cut at those strings, as the library does.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

#: Words kept per worker; the cache is only a speed-up and starts over when full.
CACHE_WORDS = 300_000
#: Longer words go through the library each time (bounds the cache's bytes).
CACHE_CHARS = 64

# Texts of these characters only: NFC leaves them alone, lower-casing is
# one to one, and \s, letters and digits are the ASCII / Latin-1 ones.
_PLAIN = re.compile(r"[\n\r\t\x20-\x7eÀ-ÖØ-öø-ÿ]*")
_LETTERS = "a-zß-öø-ÿ"
# Fixed value: the vocabulary's own split pattern, for plain lower-cased text.
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")


def default_vocab() -> str:
    import public_tokenizers
    return str(public_tokenizers.path("word_bpe_49k.json"))


def _byte_table() -> dict[int, str]:
    """The byte-level step: visible Latin-1 bytes stand for themselves, the
    others for U+0100 onward in byte order."""
    out, spare = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


_BYTES = _byte_table()


def _byte_level(word: str) -> str:
    return word.encode("utf-8").decode("latin-1").translate(_BYTES)


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        added = self.tok.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        """The text's words in order; a special token's string is one word."""
        if self._cut is not None and any(s in text for s in self.special):
            out: list[str] = []
            for part in self._cut.split(text):
                out += [part] if part in self.special else self._words(part)
            return out
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return _SPLIT.findall(text.lower())
        tok = self.tok
        text = tok.normalizer.normalize_str(text)
        # only the splitting step: the byte-level step renames characters
        return [w for w, _ in tok.pre_tokenizer[0].pre_tokenize_str(text)]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of single words (or special tokens) from ``words()``."""
        special, model = self.special, self.tok.model
        return [[special[w]] if w in special else
                [t.id for t in model.tokenize(w if w.isascii() and w.isprintable() else _byte_level(w))] for w in words]

    def learn(self, words: set[str]) -> None:
        """Put the words' ids (little-endian uint32 bytes) into the cache."""
        import numpy as np
        new = list(words.difference(self.cache))
        for i in range(0, len(new), 4096):
            part = new[i:i + 4096]
            for w, ids in zip(part, self.encode_words(part)):
                self.cache[w] = np.array(ids, "<u4").tobytes()

    def ids_bytes(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian uint32 ids of each text."""
        split = [self.words(t) if t else [] for t in texts]
        need: set[str] = set()
        for w in split:
            need.update(w)
        self.learn(need)
        get = self.cache.__getitem__
        out = [b"".join(map(get, w)) for w in split]
        if len(self.cache) > CACHE_WORDS or any(len(w) > CACHE_CHARS for w in need):
            self.trim(need)
        return out

    def trim(self, recent: set[str]) -> None:
        for w in recent:
            if len(w) > CACHE_CHARS:
                self.cache.pop(w, None)
        if len(self.cache) > CACHE_WORDS:
            self.cache = {}

    def pieces(self) -> list[str]:
        return [self.tok.id_to_token(i) for i in range(self.tok.get_vocab_size())]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
