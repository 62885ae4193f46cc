"""Token counts of a document's sections.

A document is encoded once, whole, because tokens of parts encoded alone don't add up
to the whole. Documents of a batch lie one behind the other on one axis of characters;
there each token's span is matched to the sections' spans by a merge of two sorted lists
(binary search of token starts in section starts), and a token that crosses a boundary
goes to one section by a rule:

* start: the section that holds its first character;
* end: the section that holds its last character;
* majority: the section that holds most of its characters, the earliest of equals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, slices, text_bytes
from .tokens import Encoder, le32, loaded

RULES = ("start", "end", "majority")
#: Bytes of a character after its first.
_LATER = bytes(range(0x80, 0xC0))


class SpanEncoder(Encoder):
    """Remembers of each word's tokens, 16 bits each: by how many characters the end moves on, and the characters that the token spans.

    Tokens that share a character end at the same place. Words follow each other without gaps,
    so a running sum over a whole batch gives every token's end.
    """

    def __init__(self, path: str, **kw):
        super().__init__(path, **kw)
        if not self.spaced:
            raise ValueError(f"spans need a tokenizer whose pieces are the text itself: {path}")
        # A vocabulary string has one character for each byte; special tokens have their own text.
        size = {i: len(s) for s, i in self.spec["model"]["vocab"].items()} | {i: len(s.encode()) for s, i in self.special.items()}
        if max(size.values(), default=0) > 0xFFFF:
            raise ValueError(f"tokens of over 65,535 bytes: {path}")
        self.size = [size.get(i, 0) for i in range(max(size, default=-1) + 1)]
        self.even = [n << 16 | n for n in self.size]

    def value(self, piece: str, ids: list[int]) -> bytes:
        if piece.isascii():
            return le32([self.even[i] for i in ids])
        raw, at, out = piece.encode(), 0, []
        for i in ids:
            own = raw[at : at + self.size[i]]
            at += len(own)
            begun = len(own.translate(None, _LATER))
            out.append(begun << 16 | (begun + ((own[0] & 0xC0) == 0x80)))  # it may share the character before
        return le32(out)


def spans_of(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) in characters of tokens that follow each other."""
    both = np.frombuffer(packed, "<u4").astype(np.int64)
    ends = np.cumsum(both >> 16)
    return ends - (both & 0xFFFF), ends


def owners(starts: np.ndarray, ends: np.ndarray, lows: np.ndarray, highs: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, -1 for none; whether it touches two or more) for sorted sections that don't overlap."""
    full = np.flatnonzero(highs > lows)  # empty sections hold nothing
    if not len(full):
        return np.full(len(starts), -1), np.zeros(len(starts), bool)
    low, high = lows[full], highs[full]
    at = np.searchsorted(low, starts, "right") - 1
    inside = (at >= 0) & (starts < high[at])
    owner, crossing = np.where(inside, full[at], -1), np.zeros(len(starts), bool)
    rest = np.flatnonzero(~inside | (ends > high[at]))  # the others lie in one section
    if not len(rest):
        return owner, crossing
    a, b = starts[rest], np.maximum(ends[rest], starts[rest] + 1)
    first, last = at[rest], np.searchsorted(low, b - 1, "right") - 1
    in_first, in_last = inside[rest], (last >= 0) & (b - 1 < high[last])
    crossing[rest] = (in_first != in_last) | (first != last)
    if rule == "end":
        owner[rest] = np.where(in_last, full[last], -1)
    if rule == "majority":
        some = np.flatnonzero(crossing[rest])
        a, b, first, last = a[some], b[some], np.maximum(first[some], 0), last[some]
        n = last - first + 1
        edge = np.cumsum(n) - n
        section = np.arange(n.sum()) - np.repeat(edge - first, n)
        share = np.maximum(np.minimum(np.repeat(b, n), high[section]) - np.maximum(np.repeat(a, n), low[section]), 0)
        if len(some):
            # the largest share, of equals the first
            best = np.maximum.reduceat((share << 32) - (section - np.repeat(first, n)), edge)
            most = -(-best >> 32)
            chosen = first + ((most << 32) - best)
            left = b - a - np.add.reduceat(share, edge)
            owner[rest[some]] = np.where((most > 0) & (most >= left), full[chosen], -1)
    return owner, crossing


def line_sections(text: str) -> list[tuple[int, int]]:
    """Lines with the line feed that ends them; a last line may be empty."""
    out, at = [], 0
    for line in text.split("\n"):
        out.append((at, at + len(line) + 1))
        at += len(line) + 1
    out[-1] = (out[-1][0], len(text))
    return out


def _lines_of(raw: list[bytes], chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sections of each text, starts, ends) of line_sections for texts that follow each other."""
    joined = np.frombuffer(b"".join(raw), np.uint8)
    feeds = np.flatnonzero(joined == 10)
    size = np.array([len(x) for x in raw], np.int64)
    of = np.searchsorted(np.cumsum(size), feeds, "right")
    if int(chars.sum()) != len(joined):
        feeds = np.cumsum((joined & 0xC0) != 0x80)[feeds] - 1
    number = np.bincount(of, minlength=len(raw)) + 1
    stops = np.cumsum(chars)
    ends, after = np.empty(number.sum(), np.int64), np.cumsum(number) - 1
    ends[after] = stops
    ends[np.delete(np.arange(len(ends)), after)] = feeds + 1
    starts = np.concatenate(([0], ends[:-1]))
    starts[after - number + 1] = stops - chars
    return number, starts, ends


def _given(lists: list, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sections of each text, starts, ends, room that each text takes) of given sections, each text's moved behind the last one's."""
    number, starts, ends, room = [], [], [], []
    at = 0
    for own, n in zip(lists, chars.tolist(), strict=True):
        before, furthest = 0, n
        for s in own or ():
            a, b = (None, None) if s is None else (s["start"], s["end"])
            if a is None or b is None:  # holds nothing
                a = b = before
            if b < a or a < before and b > a:
                raise ValueError("sections must be sorted and must not overlap")
            before, furthest = max(before, b), max(furthest, b)
            starts.append(at + max(0, a))
            ends.append(at + max(0, b))
        number.append(len(own or ()))
        room.append(furthest)
        at += furthest
    return np.array(number, np.int64), np.array(starts, np.int64), np.array(ends, np.int64), np.array(room, np.int64)


def attribute(spans, sections: list[tuple[int, int]], rule: str = "majority") -> tuple[list[int], int, int]:
    """(tokens of each section, tokens of none, tokens that touch two or more).

    Sections are sorted and don't overlap; what lies between them is no section. A token of
    which the rule picks a character outside all sections belongs to none; by majority,
    characters outside count together as one more candidate, the last.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    starts, ends = (np.array(x, np.int64) for x in zip(*sections, strict=True)) if sections else (np.zeros(0, np.int64),) * 2
    if (np.diff(starts) < 0).any() or (ends < starts).any() or (starts[1:] < ends[:-1]).any():
        raise ValueError("sections must be sorted and must not overlap")
    owner, crossing = owners(spans[:, 0], spans[:, 1], starts, ends, rule)
    return np.bincount(owner[owner >= 0], minlength=len(sections)).tolist() if len(sections) else [], int((owner < 0).sum()), int(crossing.sum())


def section_tokens(docs: DataFrame, tokenizer: str, sections: str | None = None, rule: str = "majority") -> DataFrame:
    """Rows (doc_id, n_tokens, n_sections, n_outside, n_crossing, section_tokens) for every row of `docs`.

    `sections` names a column array<struct<start:int,end:int>> of character spans (null: none);
    without it the sections are the lines. A section that is null or lacks an end holds nothing; ones
    out of order or overlapping are an error. section_tokens lists the tokens of each section; they
    and n_outside add up to n_tokens. A null text is empty: no tokens, one empty line. Repeated
    rows return once each; a null doc_id stays null; other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(SpanEncoder, tokenizer)
        for whole in batches:
            for part in slices(whole, "text"):
                raw = part.column(1).to_pylist()
                texts = [x.decode() for x in raw]
                chars = np.fromiter(map(len, texts), np.int64, len(texts))
                packed = [coder.ids(t) for t in texts]
                n = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
                starts, ends = spans_of(b"".join(packed))
                of = np.repeat(np.arange(len(raw)), n)
                if sections:
                    number, low, high, room = _given(part.column(2).to_pylist(), chars)
                    moved = (np.cumsum(room - chars) - (room - chars))[of]
                    starts, ends = starts + moved, ends + moved
                else:
                    number, low, high = _lines_of(raw, chars)
                owner, crossing = owners(starts, ends, low, high, rule)
                counts = np.bincount(owner[owner >= 0], minlength=len(low))
                tally = lambda rows: pa.array(np.bincount(of[rows], minlength=len(raw)), pa.int64())  # noqa: B023, E731
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(number))), pa.int32()), pa.array(counts, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(number, pa.int64()), tally(owner < 0), tally(crossing), lists], ["doc_id", "n_tokens", "n_sections", "n_outside", "n_crossing", "section_tokens"])

    return arrow_map(docs.select("doc_id", text_bytes(), *([sections] if sections else [])), run, "doc_id long, n_tokens long, n_sections long, n_outside long, n_crossing long, section_tokens array<long>")
