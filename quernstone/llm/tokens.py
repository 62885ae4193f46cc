"""Token ids of whole texts, exactly as the tokenizers library gives them, from tokenizer files of its JSON format.

A language repeats its words, so each distinct one is encoded once per worker. Where
white space is dropped, a text is cut there, and a word into pieces by the tokenizer's own
pattern, each piece merged by `merge`; words and pieces are remembered. Where spaces are part of
pieces, a text is cut into pieces at once, and those alone are remembered: words between
spaces differ more (one can end in a comma, or two lines meet in it). Texts that hold characters
outside SAFE go another way that asks the library, so no result depends on two Unicode tables agreeing.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

#: Characters of which one code point is one normal form, whose lower case is one code point by
#: every table, and whose classes (letter, number, space) are the same in every Unicode version:
#: Latin letters up to U+024F but U+0130, common dashes, quotes, the ellipsis and the euro sign.
#: U+001C to U+001F are out: not every table calls them white space.
SAFE = "\x00-\x1b\x20-įı-ɏ–—‘’“”…€"
#: The two pre-tokenisation patterns that the fast path knows, as the tokenizer files state them.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What BYTES says of texts of SAFE characters alone, with their letters, numbers and spaces written out. A letter or number run can't start as a contraction does, so it may be tried first.
_LETTERS, _NUMBERS, _SPACES = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", " \\t\\n\\r\\x0b\\x0c\\x85\\xa0"
SAFE_BYTES = rf" ?+[{_LETTERS}]++| ?+[{_NUMBERS}]++|'s|'t|'re|'ve|'m|'ll|'d| ?+[^{_SPACES}{_LETTERS}{_NUMBERS}]++|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
#: Words remembered per worker process, and a quarter as many pieces, in two generations; about 200 bytes each. Twice as many pieces where no words are.
REMEMBERED = 500_000
_SIGNS = tuple(".,;:!?")
#: ASCII characters outside SAFE.
_CONTROLS = ("\x1c", "\x1d", "\x1e", "\x1f")


class Remembered(dict):
    """A dict of bounded size in two generations: what the older one has is moved up when it is met again."""

    def __init__(self, fill, most: int = REMEMBERED):
        super().__init__()
        self.fill, self.most, self.old = fill, max(2, most) // 2, {}

    def __missing__(self, word):
        if (found := self.old.pop(word, None)) is None:
            found = self.fill(word)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it prints, else the next one from U+0100."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    stand_in = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(stand_in)) for b in range(256)]


def le32(ids) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return array("I", ids).tobytes() if _LITTLE else np.asarray(ids, dtype="<u4").tobytes()


_LITTLE = np.little_endian and array("I").itemsize == 4


class Encoder:
    """Encodes with the library's model and keeps each word's ids as bytes; subclasses merge in another way or keep more."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import regex
        from tokenizers import Tokenizer

        self.path = path
        self.spec = spec = json.loads(open(path, encoding="utf-8").read())
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.symbols = byte_symbols()
        normal, cutter = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
        steps, cutters = [x["type"] for x in normal.get("normalizers", [])], cutter.get("pretokenizers", [])
        model = spec["model"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("byte_fallback", "dropout", "ignore_merges", "continuing_subword_prefix")) and not spec.get("post_processor")
        plain = plain and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        self.lower = plain and steps == ["NFC", "Replace", "Lowercase"] and len(cutters) == 2 and cutters[0].get("pattern") == {"Regex": WORDS} and cutters[0]["invert"] and not cutters[1]["use_regex"]
        self.spaced = plain and not normal and cutter.get("type") == "ByteLevel" and cutter["use_regex"] and not cutter["add_prefix_space"]
        if not (self.lower or self.spaced):
            raise ValueError(f"this tokenizer file has settings that aren't implemented: {path}")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.starts = sorted({s[0] for s in self.special})
        self.cut = regex.compile(WORDS if self.lower else BYTES).findall
        self.safe_cut, self.unsafe = re.compile(SAFE_BYTES).findall, re.compile(f"[^{SAFE}]").search
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.space = self.symbols[32]
        self.ascii = {b: c for b, c in enumerate(self.symbols[:128]) if chr(b) != c}
        self.words = Remembered(self.encode_word, remembered)
        self.pieces = Remembered(lambda piece: self.value(piece, self.merge(piece)), 2 * remembered if self.spaced else remembered // 4)

    def odd(self, text: str) -> bool:
        """Whether the text has characters outside SAFE."""
        return any(c in text for c in _CONTROLS) if text.isascii() else bool(self.unsafe(text))

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece."""
        if piece.isascii():
            letters = piece.replace(" ", self.space) if piece.isprintable() else piece.translate(self.ascii)
        else:
            letters = "".join([self.symbols[b] for b in piece.encode()])
        return [t.id for t in self.model.tokenize(letters)]

    def value(self, piece: str, ids: list[int]):
        """What is remembered of a piece."""
        return le32(ids)

    def combine(self, values: list):
        """What is remembered of a word, from its pieces' values."""
        return b"".join(values)

    def encode_word(self, word: str):
        """The value of a new word. Letters alone are one piece, and a sign behind them is a piece of its own."""
        if word.isalpha():
            return self.value(word, self.merge(word))
        if word[-1:] in _SIGNS and word[-2:-1].isalpha():
            return self.combine([self.words[word[:-1]], self.pieces[word[-1]]])
        return self.combine([self.pieces[p] for p in self.cut(word)])

    def through_library(self, text: str):
        """Value of a text without special tokens, cut by the library itself."""
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        own = [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return self.combine([self.value(p, self.merge(p)) for p in own])

    def segment(self, text: str) -> list:
        if self.odd(text):
            return [self.through_library(text)]
        if self.lower:
            return list(map(self.words.__getitem__, text.lower().split()))
        return list(map(self.pieces.__getitem__, self.safe_cut(text)))

    def values(self, text: str) -> list:
        """What is remembered of the text's words or pieces, in order. Special tokens are found in the text as it stands."""
        if not any(c in text for c in self.starts) or not self.at_special.search(text):
            return self.segment(text)
        out: list = []
        for part in self.at_special.split(text):
            if part in self.special:
                out.append(self.value(part, [self.special[part]]))
            elif part:
                out += self.segment(part)
        return out

    def ids(self, text: str) -> bytes:
        """The whole text's ids, little-endian unsigned 32-bit."""
        return b"".join(self.values(text))


_LOADED: dict[tuple, Encoder] = {}


def loaded(kind: type[Encoder], path: str, remembered: int = REMEMBERED) -> Encoder:
    """One encoder per worker process, kind, file and bound, with what it remembers."""
    if (kind, path, remembered) not in _LOADED:
        _LOADED[kind, path, remembered] = kind(path, remembered=remembered)
    return _LOADED[kind, path, remembered]


def public_tokenizer(name: str) -> str:
    """The place of a tokenizer file of the installed collection."""
    import public_tokenizers

    return public_tokenizers.path(name)
