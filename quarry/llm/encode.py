"""Word-cached encoding with a public tokenizer whose vocabulary never joins across ASCII white space."""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .common import split_words

#: Outside this range lower-casing or composing a character can depend on more than the character; such texts skip the case folding.
_PLAIN = re.compile("[^\x00-įı-ɏ]")
_MAX_ENTRIES = 500_000
_MAX_WORD = 64
#: How the vocabulary cuts a word into pieces that it encodes one by one, and the same for lines of words of _LATIN alone.
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LATIN = re.compile("[\\n!-~À-ÖØ-öø-įı-ſ]*").fullmatch
_CUT_LATIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|\\n|[^\\na-z0-9ß-öø-ſ]+").findall
_MAX_PIECES = 100_000
_encoders: dict[str, "WordEncoder"] = {}


class _Pieces(dict):
    """piece of a word -> its ids, packed; a line end has none. Bounded: begun anew after _MAX_PIECES pieces."""

    def __init__(self, tokenizer, letters: dict[int, str]) -> None:
        super().__init__()
        self.tokenize, self.letters = tokenizer.model.tokenize, letters

    def __missing__(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        ids = array("I", [x.id for x in self.tokenize(letters)] if piece != "\n" else []).tobytes()
        if len(piece) <= _MAX_WORD:
            if len(self) >= _MAX_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class _Cache(dict):
    """word -> its ids as little-endian unsigned 32-bit bytes. Bounded: beyond _MAX_ENTRIES words are encoded anew each time."""

    def __init__(self, tokenizer) -> None:
        super().__init__()
        self.tokenizer = tokenizer
        steps = json.loads(tokenizer.to_str()).get("pre_tokenizer") or {}
        steps = steps.get("pretokenizers", [])
        #: lower-case letters alone are one piece, so the merge table can be asked straight away
        self.by_model = [x["type"] for x in steps] == ["Split", "ByteLevel"] and r"[\p{L}]+" in steps[0]["pattern"].get("Regex", "")
        self.bytes = {i: c for i, c in enumerate(_byte_letters()) if chr(i) != c}
        self.tail = {p: self.raw(p) for p in ",."}
        #: folding case outside the tokenizer only if it folds case itself
        self.folds = self.raw("A") == self.raw("a")
        self.pieces = _Pieces(tokenizer, self.bytes) if self.by_model and self.folds and steps[0]["pattern"]["Regex"] == _CUT and steps[0]["invert"] else None

    def raw(self, word: str) -> bytes:
        if self.by_model and word.isalpha() and not _PLAIN.search(word) and word.islower():
            piece = word if word.isascii() else word.encode().decode("latin-1").translate(self.bytes)
            ids = [x.id for x in self.tokenizer.model.tokenize(piece)]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def raw_words(self, word: str) -> bytes:
        """Ids of one word without white space, past the cache."""
        if not self.folds:
            return self.raw(word)
        if word.isascii():
            word = word.lower() if "<|" not in word else word
            if self.by_model and len(word) > 1 and word[-1] in ",." and word[:-1].isalpha():
                return self.raw(word[:-1]) + self.tail[word[-1]]
        elif not _PLAIN.search(word) and unicodedata.is_normalized("NFC", word):
            word = word.lower()
        return self.raw(word)

    def raw_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, how many each has), past the cache. Latin words are cut into pieces together."""
        lines = b"\n".join(words).decode("utf-8", "surrogatepass")
        if self.pieces is None or "<|" in lines or not _LATIN(lines):
            parts = [self.raw_words(w.decode("utf-8", "surrogatepass")) for w in words]
            return np.frombuffer(b"".join(parts), "<u4"), np.array([len(x) // 4 for x in parts], np.int64)
        cut = _CUT_LATIN(lines.lower())
        parts = list(map(self.pieces.__getitem__, cut))
        owner = np.cumsum(np.array([x == "\n" for x in cut], np.int64))
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        return np.frombuffer(b"".join(parts), "<u4"), np.bincount(owner, size, minlength=len(words)).astype(np.int64)

    def __missing__(self, word: str) -> bytes:
        # a comma or full stop after a letter is a piece of its own, so the word before it can be shared
        ids = self[word[:-1]] + self.tail[word[-1]] if len(word) > 1 and word[-1] in ",." and word[-2].isalpha() else self.raw(word)
        if len(self) < _MAX_ENTRIES and len(word) <= _MAX_WORD:
            self[word] = ids
        return ids


def _byte_letters() -> list[str]:
    """Byte-level vocabularies write each byte as one visible character: itself if it is one, else the next from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class WordEncoder:
    """encode(text) equals Tokenizer.encode(text, add_special_tokens=False).ids, as packed bytes; encode_all() does many."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.cache = _Cache(tokenizer)
        self.folds = self.cache.folds

    def _folded(self, text: str | None) -> str | None:
        return text.lower() if text and self.folds and not _PLAIN.search(text) and unicodedata.is_normalized("NFC", text) and "<|" not in text else text

    def encode_all(self, texts: list[str | None]) -> tuple[Callable[[], np.ndarray], np.ndarray]:
        """(ids, lengths): the number of ids of every text, and what makes the ids of all texts in a row. Null has none.

        Only ASCII white space parts words here; other white space is left to the tokenizer. Each distinct word is looked
        up once."""
        owner, place, words = split_words(pa.array(list(map(self._folded, texts)), pa.string()))
        parts = list(map(self.cache.__getitem__, words.cast(pa.string()).to_numpy(zero_copy_only=False)))
        size = np.array([len(p) // 4 for p in parts], dtype=np.int64)

        def ids() -> np.ndarray:
            each = size[place]
            return np.frombuffer(b"".join(parts), "<u4")[np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each - (np.cumsum(size) - size)[place], each)]

        return ids, np.bincount(owner, size[place], minlength=len(texts)).astype(np.int64)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]().tobytes()


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> WordEncoder:
    """One encoder per file and worker process. path: a file, or the bare name of a public vocabulary."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path if "/" in path else public_path(path))
    return _encoders[path]
