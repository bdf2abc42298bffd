"""Token ids of whole texts from the tokenizers library, in Spark tasks.

The tokenizer's pre-tokenizer never crosses white space, so a text's ids are
the concatenation of the ids of its white-space separated chunks; and a chunk
that is one Latin word between punctuation is three pre-tokens, whose ids the
library's model gives.  Corpora repeat their words, so each task keeps the ids
of the chunks and words it has met and asks the library only for the others.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np

#: Characters that str.split() takes for white space and the tokenizer does not.
_ODD = "\x1c\x1d\x1e\x1f"
#: Punctuation that never joins a word's pre-token or a special token.
_PUNCT = '!"#$%&()*+,-./:;=?@[\\]^_`{}~'
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
CACHE_CHUNKS = 600_000
CACHE_WORDS = 800_000


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Known(dict):
    """key -> ids as bytes; asks ``find`` for others and keeps a bounded number.

    When full it keeps what it has, the frequent ones among it, and starts anew
    only after as many misses again, when the texts have changed.
    """

    def __init__(self, find: Callable[[str], bytes], limit: int):
        super().__init__()
        self.find, self.limit, self.missed = find, limit, 0

    def __missing__(self, key: str) -> bytes:
        ids = self.find(key)
        if len(self) < self.limit:
            self[key] = ids
        else:
            self.missed += 1
            if self.missed > self.limit:
                self.clear()
                self.missed = 0
        return ids


class ChunkEncoder:
    """encode(texts): one array of ids per text (None: empty).

    ``word`` gives the ids of one lower-case Latin word or run of punctuation,
    ``whole`` those of any text.
    """

    def __init__(self, word: Callable[[str], bytes], whole: Callable[[str], bytes], kind: type):
        self.kind, self.whole = kind, whole
        self.words = _Known(word, CACHE_WORDS)
        self.words[""] = b""
        self.chunks = _Known(self._chunk, CACHE_CHUNKS)

    def _chunk(self, chunk: str) -> bytes:
        core = chunk.strip(_PUNCT)
        if core.isalpha() and (core.isascii() or _LATIN(core)):
            words = self.words
            if len(core) == len(chunk):
                return words[core.lower()]
            at = chunk.index(core)
            before, after = chunk[:at], chunk[at + len(core) :]
            return (words[before] if before else b"") + words[core.lower()] + (words[after] if after else b"")
        return self.whole(chunk)

    def encode_bytes(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(x in text for x in _ODD):
            return self.whole(text)
        return b"".join(map(self.chunks.__getitem__, text.split()))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        return [np.frombuffer(self.encode_bytes(x), self.kind) for x in texts]


def byte_letters() -> list[str]:
    """The printable character that stands for each byte value in byte-level vocabularies."""
    keep = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b) if b in keep else chr(spare))
        spare += b not in keep
    return out


def library_encoder(path: str) -> ChunkEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    lib.no_truncation()
    lib.no_padding()
    kind = np.uint16 if lib.get_vocab_size() <= 0xFFFF else np.uint32
    tokenize, letters = lib.model.tokenize, dict(enumerate(byte_letters()))

    def word(x: str) -> bytes:
        spelt = x.encode("utf-8").decode("latin-1").translate(letters)
        return np.array([t.id for t in tokenize(spelt)], kind).tobytes()

    def whole(x: str) -> bytes:
        return np.array(lib.encode_batch_fast([x], add_special_tokens=False)[0].ids, kind).tobytes()

    out = ChunkEncoder(word, whole, kind)
    out.lib = lib
    return out


#: White space, letters and numbers among the first 256 characters, as byte-level vocabularies tell them apart (fixed values).
_S, _L, _N = r"\t-\r \x85\xa0", "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: Their pre-tokens (fixed pattern): word ends after an apostrophe, then words, numbers and other characters with the space before them, then white space.
_PRE_TOKENS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+").findall
_BEYOND = re.compile(r"[^\x00-\xff]").search


class SpacedEncoder(ChunkEncoder):
    """The same for byte-level vocabularies, whose pre-tokens keep the space before them.

    A text of the first 256 characters is cut into its pre-tokens, whose ids are known or
    come from the library's model.  In other texts nothing joins what stands before a space
    with a non-space after it: they are cut there, and units with other characters go to
    the library, as does a text that spells a special token.
    """

    cut = re.compile(r" (?=\S)").split

    def __init__(self, word: Callable[[str], bytes], whole: Callable[[str], bytes], kind: type, special: list[str]):
        super().__init__(word, whole, kind)
        self.special = special

    def _chunk(self, chunk: str) -> bytes:
        return self.whole(chunk) if _BEYOND(chunk) else b"".join(map(self.words.__getitem__, _PRE_TOKENS(chunk)))

    def encode_bytes(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(x in text for x in self.special):
            return self.whole(text)
        if not _BEYOND(text):
            return b"".join(map(self.words.__getitem__, _PRE_TOKENS(text)))
        first, *rest = self.cut(text)
        return (self.chunks[first] if first else b"") + b"".join([self.chunks[" " + x] for x in rest])


def spaced_encoder(path: str) -> SpacedEncoder:
    plain = library_encoder(path)
    return SpacedEncoder(plain.words.find, plain.whole, plain.kind, [x.content for x in plain.lib.get_added_tokens_decoder().values()])


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str, spaced: bool = False) -> ChunkEncoder:
    """One encoder per Python worker and vocabulary file; ``spaced``: byte-level with spaces kept."""
    if path not in _ENCODERS:
        _ENCODERS[path] = (spaced_encoder if spaced else library_encoder)(path)
    return _ENCODERS[path]
