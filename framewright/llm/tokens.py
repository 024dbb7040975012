"""Token ids by the tokenizers library, with a bounded cache of words.

A byte-level BPE vocabulary splits a text into words before it merges. A single
space between two characters that are not blank always begins a new such word; a
single line feed between two of them, and a mark after a letter, are words of
their own. So the parts between these places have their ids on their own: those
seen before come from the cache, new ones are encoded by the library. A text with
any other white space is encoded by the library as a whole. A vocabulary file of another
kind, with a normalizer or another rule of words, has all its texts encoded as a whole.
"""

from __future__ import annotations

import json
from array import array

CACHE_WORDS = 1_300_000  # entries, about 200 bytes each; when it is full it starts anew
LONG_WORD = 64  # characters; a text with a longer new word is encoded as a whole
_MARKS = frozenset(".,;:!?")
_ODD = frozenset("\0<᠎﻿​")
END = bytes(4)


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def _byte_level(spec: dict) -> bool:
    """Whether the file is a plain byte-level BPE, whose words have their ids on their own."""
    rule, model = spec.get("pre_tokenizer") or {}, spec["model"]
    return (spec.get("normalizer") is None and rule.get("type") == "ByteLevel" and rule.get("use_regex", True)
            and not rule.get("add_prefix_space") and model.get("type") == "BPE"
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
            and all(t["content"].startswith("<") and not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in spec.get("added_tokens") or []))


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.by_words = _byte_level(json.loads(self.tokenizer.to_str()))
        self.letters = _byte_letters()
        self.words: dict[str, bytes] = {}
        self.signs = {c: self._whole(c) for c in ("\n", *_MARKS)}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _letters(self, word: str) -> bytes:
        """Ids of a word of letters after a space."""
        shown = "\u0120" + word if word.isascii() else (" " + word).encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _learn(self, word: str) -> bytes | None:
        """Ids of a word of the cache, None where a text with it must be encoded as a whole.

        A word is written as it is after a space, with a leading ``\\0`` after a line feed and with
        a leading ``\\0\\0`` at the start of a text.
        """
        found = self.words.get(word)
        if found is not None:
            return found
        body = word.lstrip("\0")
        lead = len(word) - len(body)
        if not body or lead > 2 or len(body) > LONG_WORD or not _ODD.isdisjoint(body) or body.split() != [body]:
            return None
        if lead == 1:
            found = self.signs["\n"] + self._learn("\0\0" + body)
        elif len(body) > 1 and body[-1] in _MARKS and body[-2].isalpha():
            base = word[:-1]
            found = (self.words.get(base) or self._learn(base)) + self.signs[body[-1]]
        elif body.isalpha() and not lead:
            found = self._letters(body)
        else:
            found = self._whole(body if lead else " " + body)
        self.words[word] = found
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers; null counts as empty.

        Names of special tokens inside a text are read as the library does by default.
        """
        if len(self.words) > CACHE_WORDS:
            self.words = {}
        if not self.by_words:
            return [self._whole(t or "") for t in texts]
        words = self.words
        cut = [("\0\0" + t.replace("\n", " \0")).split(" ") if t else [] for t in texts]
        bad = set()
        for w in set().union(*cut).difference(words):
            if w.isalpha() and len(w) <= LONG_WORD:
                words[w] = self._letters(w)
            elif self._learn(w) is None:
                bad.add(w)
        out = []
        for text, pieces in zip(texts, cut):
            if bad and not bad.isdisjoint(pieces):
                out.append(self._whole(text))
            else:
                out.append(b"".join(map(words.__getitem__, pieces)))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def groups(texts: list, most: int = 4 << 20):
    """Cut a batch into runs of about ``most`` characters: ``(first row, texts)``."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield start, texts[start:k + 1]
            start, size = k + 1, 0
    if start < len(texts):
        yield start, texts[start:]
