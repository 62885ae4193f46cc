"""Language identification by multilingual mixture inference.

Each language has a letter model: the chance of a byte after the two before it, counted
over all labelled documents. A document is a mixture: every word is drawn from one
language, so expectation-maximisation over its words' likelihoods gives the languages'
proportions. The set of languages is the one of best penalised likelihood (each further
language must pay for itself), and the largest proportion names the document.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, slices, text_bytes

#: Three-byte strings are counted in this many buckets per language, two-byte ones in as many: 0.5 MB a language.
BUCKETS = 1 << 16
#: Languages that a model may have; more are an error, since the model goes to every task.
LANGUAGES = 400
#: What each language of a document after the first must add to the log likelihood, in halves of log(words).
PENALTY = 4.0
UNKNOWN = "und"

_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_CHUNK = 1 << 20


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text)) if not text.isascii() else text.translate(_NO_ASCII_LETTERS) != text


_NO_ASCII_LETTERS = {c: None for c in range(128) if chr(c).isalpha()}


def words_of(text: str) -> list[bytes]:
    """Lower-case words: runs of ASCII letters and of bytes of other characters."""
    return unicodedata.normalize("NFC", text).lower().encode().translate(_LETTERS).split()


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of three bytes, of their first two) for each letter of each word between spaces, and the words' lengths."""
    x = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    two = x[:-2] << 8 | x[1:-1]
    three = ((two << 8 | x[2:]) * np.uint32(2654435761)) >> np.uint32(16)
    inside = x[1:-1] != 32  # else the window goes from one word to the next
    return three[inside].astype(np.int64), two[inside].astype(np.int64), np.fromiter(map(len, words), np.int64, len(words))


def _chunks(words: list[bytes]) -> Iterator[list[bytes]]:
    size, own = 0, []
    for w in words:
        own.append(w)
        size += len(w) + 1
        if size >= _CHUNK:
            yield own
            size, own = 0, []
    if own:
        yield own


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for whole in batches:
        for part in slices(whole, "text", _CHUNK):
            by: dict[str, list[bytes]] = {}
            for lang, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).extend(words_of(raw.decode()))
            for lang, words in by.items():
                own = counts.setdefault(lang, np.zeros(2 * BUCKETS, np.int64))
                for chunk in _chunks(words):
                    three, two, _ = _grams(chunk)
                    own[:BUCKETS] += np.bincount(three, minlength=BUCKETS)
                    own[BUCKETS:] += np.bincount(two, minlength=BUCKETS)
    for lang, own in counts.items():
        some = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(own[some])], ["lang", "bucket", "n"])


def _whole(table: pa.Table) -> pa.Table:
    """One language's counts as one row of 32-bit floating numbers."""
    own = np.zeros(2 * BUCKETS, np.float32)
    own[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return pa.table({"lang": [table.column("lang")[0].as_py()], "counts": pa.array([own.tobytes()], pa.binary())})


class Mixture:
    """Letter models of sorted languages, and the inference over documents."""

    def __init__(self, langs: list[str], counts: list[np.ndarray], add: float = 0.1):
        self.langs = langs
        self.three, self.two = (np.empty((BUCKETS, len(langs)), np.float32) for _ in range(2))
        for k, own in enumerate(counts):
            self.three[:, k] = np.log(own[:BUCKETS].astype(np.float64) + add)
            self.two[:, k] = np.log(own[BUCKETS:].astype(np.float64) + add * 64)

    def likelihoods(self, words: list[bytes]) -> np.ndarray:
        """Log likelihood of each word under each language."""
        out = []
        for chunk in _chunks(words):
            three, two, lengths = _grams(chunk)
            out.append(np.add.reduceat(self.three[three] - self.two[two], np.cumsum(lengths) - lengths, axis=0))
        return np.concatenate(out)

    def infer(self, words: list[list[bytes]], rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
        """Proportions (documents by languages, 0 outside the chosen set) and the number of chosen languages; each document has a word."""
        n = np.array([len(w) for w in words])
        starts = np.cumsum(n) - n
        of = np.repeat(np.arange(len(words)), n)
        log = self.likelihoods([w for own in words for w in own])
        total = np.add.reduceat(log.astype(np.float64), starts, axis=0)
        top = log.max(1, keepdims=True)
        ratio = np.exp(log - top)
        base = np.add.reduceat(top[:, 0].astype(np.float64), starts)
        langs = len(self.langs)

        def maximise(share: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
            for _ in range(times):
                mine = ratio * share[of]
                mine /= np.maximum(mine.sum(1, keepdims=True), 1e-30)
                share = (np.add.reduceat(mine, starts, axis=0) / n[:, None]).astype(np.float32)
            fit = np.add.reduceat(np.log(np.maximum((ratio * share[of]).sum(1), 1e-30).astype(np.float64)), starts)
            return share, fit + base

        rows = np.arange(len(words))
        best = np.zeros((len(words), langs), np.float32)
        single = total.argmax(1)
        best[rows, single] = 1
        value, chosen = total[rows, single], np.ones(len(words), np.int64)
        if langs > 1:
            share, _ = maximise(np.full((len(words), langs), 1 / langs, np.float32), rounds)
            rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1)
            # sets grow as long as the next language has half a word in any document
            most = (share * n[:, None] >= 0.5).sum(1)
            for k in range(2, int(most.max()) + 1):
                kept = np.where(rank < k, share + 1e-6, 0)
                mixed, fit = maximise((kept / kept.sum(1, keepdims=True)).astype(np.float32), 4)
                fit = fit - (k - 1) * PENALTY * 0.5 * np.log(np.maximum(n, 2))
                better = (fit > value) & (k <= most)
                best[better], value[better], chosen[better] = mixed[better], fit[better], k
        return best, chosen


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame) -> Mixture | None:
    """A model of the labelled rows that aren't held out (null doc_id: not learned from); None without any.

    All of them are counted; what comes to the driver is one row of 4 * 2 * BUCKETS bytes a language.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("lang").cast("string").alias("lang"), text_bytes())
    counts = arrow_map(known, _counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = counts.groupBy("lang").applyInArrow(_whole, "lang string, counts binary").limit(LANGUAGES + 1).toArrow()
    if rows.num_rows > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages, which is what a model may have")
    own = dict(zip(*(c.to_pylist() for c in rows.columns), strict=True))
    return Mixture(sorted(own), [np.frombuffer(own[x], np.float32) for x in sorted(own)]) if own else None


def identify(docs: DataFrame, model: Mixture | None = None) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score, n_langs) for every row of `docs`, by a model of `docs` unless one is given.

    A prediction sees the text alone. score is the predicted language's proportion of words. A
    text that is null or has no letter is `und` with score 0, and so is every text where there is
    nothing to learn from. Equal proportions: the first language in order. A null doc_id isn't held
    out; repeated rows return once each; other columns are ignored.
    """
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for part in slices(whole, "text", _CHUNK):
                texts = [t.decode() for t in part.column(2).to_pylist()]
                words = [words_of(t) if own and has_letter(t) else [] for t in texts]
                told = [k for k, w in enumerate(words) if w]
                names, scores, numbers = [UNKNOWN] * len(texts), [0.0] * len(texts), [0] * len(texts)
                if told:
                    share, chosen = own.infer([words[k] for k in told])
                    for k, best, value, number in zip(told, share.argmax(1).tolist(), share.max(1).tolist(), chosen.tolist(), strict=True):
                        names[k], scores[k], numbers[k] = own.langs[best], min(1.0, value), number
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names), pa.array(scores, pa.float64()), pa.array(numbers, pa.int64())], ["doc_id", "held_out", "lang_pred", "score", "n_langs"])

    return arrow_map(docs.select("doc_id", held_out().alias("held_out"), text_bytes()), run, "doc_id long, held_out boolean, lang_pred string, score double, n_langs long")
