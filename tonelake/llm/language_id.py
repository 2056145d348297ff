"""Language identification by unigram pieces summed over all segmentations.

Each language has probabilities over the pieces of a fixed public vocabulary. A word's probability is the sum over all ways to
cut it into pieces, by a forward pass; a text's is the product over its words. The probabilities are fitted by expectation
maximisation on the word counts of a sample of labelled texts, bounded for each language: the same forward pass, and a backward one, give every piece's
expected count. A word's scores in all languages are computed once per worker and looked up after that.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, stored, texts_of, with_body
from .tables import ChunkTable, held

#: Labelled texts that the model is fitted on, about at most, shared out evenly among the languages; and at least so many of each.
SAMPLE, EACH = 6000, 500
ROUNDS = 3
LONGEST_PIECE = 16
#: Words longer than this are summed as logarithms, which neither overflow nor fall to 0.
PLAIN = 40
#: Probability of a letter that is no piece.
UNKNOWN = 1e-9
#: Every piece counts times this for each of its letters, else the product over a word of a large script falls to 0.
SCALE = 1e6


@cache
def _pattern() -> re.Pattern:
    """A letter of any script, then letters and the marks that scripts write on them."""
    kinds = {"L": [], "M": []}
    for c in range(sys.maxunicode + 1):
        own = kinds.get(unicodedata.category(chr(c))[0])
        if own is not None:
            if own and own[-1][1] == c - 1:
                own[-1][1] = c
            else:
                own.append([c, c])
    letters, marks = ("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in kinds[k]) for k in "LM")
    return re.compile(f"[{letters}][{letters}{marks}]*")


#: The letters among the first 256 characters, in lower case.
_LATIN = re.compile("[a-zªµºß-öø-ÿ]+")


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case, with their marks. A text of the first 256 characters needs a small pattern only, which is ten times faster."""
    text = text.lower()
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _pattern().findall(text)
    return _LATIN.findall(text)


def _is_word(text: str) -> bool:
    return all(unicodedata.category(c)[0] in "LM" for c in text) and text != ""


def vocabulary(model: str) -> dict[str, int]:
    """Pieces of letters in lower case or without case, with or without a marker in front."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    good = [p for p in pieces if len(p) <= LONGEST_PIECE and (p == "▁" or _is_word(p.removeprefix("▁")) and p == p.lower())]
    return {p: i for i, p in enumerate(good)}


class Lattice:
    """Arcs of all segmentations of words of one length: for each (start, end) the piece of every word, or none."""

    def __init__(self, words: list[str], vocab: dict[str, int]):
        self.n, self.size = len(words[0]) + 1, len(words)
        self.marked, self.vocab = ["▁" + w for w in words], vocab
        self.arcs = [x for j in range(1, self.n + 1) for x in self.ending(j)] if self.n <= PLAIN else None

    def ending(self, j: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """Arcs that end at a place."""
        none, letter = len(self.vocab), len(self.vocab) + 1
        for i in range(max(0, j - LONGEST_PIECE), j):
            other = letter if j == i + 1 else none
            ids = np.fromiter((self.vocab.get(w[i:j], other) for w in self.marked), np.int64, self.size)
            if j == i + 1 or (ids != none).any():
                yield i, j, ids

    def forward(self, p: np.ndarray) -> np.ndarray:
        """``p``: pieces x languages, with a row of 0 and one of UNKNOWN at the end. Gives positions x words x languages."""
        a = np.zeros((self.n + 1, self.size, p.shape[1]))
        a[0] = 1
        for i, j, ids in self.arcs:
            a[j] += a[i] * p[ids]
        return a

    def log_forward(self, log_p: np.ndarray) -> np.ndarray:
        """The same with logarithms."""
        a = np.full((self.n + 1, self.size, log_p.shape[1]), -np.inf)
        a[0] = 0
        for j in range(1, self.n + 1):
            for i, _, ids in self.ending(j):
                a[j] = np.logaddexp(a[j], a[i] + log_p[ids])
        return a

    def totals(self, p: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """Logarithms of the words' sums."""
        return np.log(self.forward(p)[-1]) if self.n <= PLAIN else self.log_forward(log_p)[-1]

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of every piece, for word counts of words x languages."""
        if self.n > PLAIN:
            return self._log_expected(p, counts)
        a = self.forward(p)
        b = np.zeros_like(a)
        b[self.n] = counts / a[self.n]
        out = np.zeros_like(p)
        for i, j, ids in sorted(self.arcs, key=lambda x: -x[1]):
            use = p[ids] * b[j]
            b[i] += use
            np.add.at(out, ids, a[i] * use)
        return out

    def _log_expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            log_p, log_n = np.log(p), np.log(counts)
        a = self.log_forward(log_p)
        b = np.full_like(a, -np.inf)
        b[self.n] = log_n - a[self.n]
        out = np.zeros_like(p)
        for j in range(self.n, 0, -1):
            for i, _, ids in self.ending(j):
                use = log_p[ids] + b[j]
                b[i] = np.logaddexp(b[i], use)
                np.add.at(out, ids, np.exp(a[i] + use))
        return out


def _together(n: int) -> int:
    """How many words of ``n`` letters are solved at a time."""
    return max(1, min(4096, 50_000 // (n + 1)))


def _by_length(words: list[str]) -> dict[int, list[int]]:
    out = defaultdict(list)
    for k, w in enumerate(words):
        out[len(w)].append(k)
    return out


class WordScores(ChunkTable):
    """Log-probabilities of distinct words in all languages."""

    limit = 150_000

    def __init__(self, vocab: dict[str, int], p: np.ndarray):
        self.vocab, self.p = vocab, p
        with np.errstate(divide="ignore"):
            self.log_p = np.log(p)
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.scores = np.empty((0, self.p.shape[1]), np.float32)

    def fill(self, new: list) -> None:
        got = np.empty((len(new), self.p.shape[1]), np.float32)
        for n, own in _by_length(new).items():
            for k in range(0, len(own), _together(n)):
                at = own[k : k + _together(n)]
                lattice = Lattice([new[i] for i in at], self.vocab)
                got[at] = lattice.totals(self.p, self.log_p) - lattice.n * math.log(SCALE)
        self.scores = np.concatenate([self.scores, got])


def _padded(p: np.ndarray, vocab: dict[str, int]) -> np.ndarray:
    """Scaled probabilities, with the rows for none and for a letter that is no piece."""
    sizes = np.array([len(x) for x in vocab], float)[:, None]
    return np.concatenate([p * SCALE**sizes, np.zeros((1, p.shape[1])), np.full((1, p.shape[1]), UNKNOWN * SCALE)])


def _count_words(batches):
    total: dict[str, Counter] = defaultdict(Counter)
    for batch in slices(batches):
        for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
            total[lang].update(words_of(text))
        if sum(map(len, total.values())) > 200_000:
            yield from _word_rows(total)
            total.clear()
    yield from _word_rows(total)


def _word_rows(total):
    for lang, c in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])


def _expect(batches, vocab: dict[str, int], shared, langs: list[str]):
    place = {x: k for k, x in enumerate(langs)}
    p = shared.value
    total = np.zeros_like(p)
    for batch in batches:
        lang, word, n = (c.to_pylist() for c in batch.columns)
        for letters, own in _by_length(word).items():
            for k in range(0, len(own), _together(letters)):
                at = own[k : k + _together(letters)]
                counts = np.zeros((len(at), len(langs)))
                counts[np.arange(len(at)), [place[lang[i]] for i in at]] = [n[i] for i in at]
                total += Lattice([word[i] for i in at], vocab).expected(p, counts)
    piece, who = np.nonzero(total[: len(vocab)])
    yield pa.RecordBatch.from_arrays([pa.array(who.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[piece, who])], names=["lang", "piece", "n"])


def fit(labelled: DataFrame, model: str, lang: str = "lang", text: str = "text", order: str = "doc_id") -> tuple[list[str], np.ndarray, np.ndarray] | None:
    """Languages, piece probabilities and priors.

    Each language is fitted on about ``SAMPLE`` / languages of its labelled rows (``EACH`` where that is less), chosen by a hash of ``order`` and the text;
    on all of them if it has fewer than twice as many. The prior is a language's share of all labelled words: those of its sample,
    weighted by its full count of rows.
    """
    spark = labelled.sparkSession
    name = F.col(lang).cast("string")
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    full = {r["lang"]: r["n"] for r in rows.groupBy(name.alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not full:
        return None
    bound = max(EACH, SAMPLE // len(full))
    parts = {x: 1.0 if n < 2 * bound else bound / n for x, n in full.items()}
    some = rows
    if min(parts.values()) < 1:
        shares = spark.createDataFrame([(x, int(v * (1 << 40))) for x, v in parts.items()], "__lang string, __share long")
        some = rows.join(F.broadcast(shares), name == F.col("__lang")).where(F.pmod(F.xxhash64(order, text, F.lit(11)), F.lit(1 << 40)) < F.col("__share"))
    some = stored(some.select(name.alias("lang"), F.col(text).alias("text")))
    taken = {r["lang"]: r["n"] for r in some.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    missed = [x for x in full if x not in taken]
    if missed:  # repeated rows share a hash, so a language can be left out: all its rows then
        some = some.unionByName(rows.where(name.isin(missed)).select(name.alias("lang"), F.col(text).alias("text")))
        taken |= {x: full[x] for x in missed}
    words = stored(some.select("lang", "text").mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    per = {r["lang"]: r["n"] * full[r["lang"]] / taken[r["lang"]] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(per)
    if not langs:
        return None
    vocab = vocabulary(model)
    p = np.full((len(vocab), len(langs)), 1 / len(vocab))
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(_padded(p, vocab))
        got = words.mapInArrow(lambda it, s=shared: _expect(it, vocab, s, langs), "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow().to_pandas()
        counts = np.full_like(p, 0.01)
        counts[got["piece"].to_numpy(), got["lang"].to_numpy()] += got["n"].to_numpy()
        p = counts / counts.sum(0)
    sizes = np.array([per[x] for x in langs], float)
    return langs, p, np.log((sizes + 1) / (sizes.sum() + len(langs)))


def _predict(batches, vocab: dict[str, int], shared, langs: list[str], prior: np.ndarray, name: str, body: str, n_keep: int):
    table = held((WordScores, name), lambda: WordScores(vocab, _padded(shared.value, vocab)))
    for batch in slices(batches, body):
        codes, counts = table.look_up([words_of(t) for t in texts_of(batch, body)])
        sums = np.concatenate([np.zeros((1, len(langs))), np.cumsum(table.scores[codes], 0, dtype=np.float64)])
        ends = np.cumsum(counts)
        total = sums[ends] - sums[ends - counts] + prior
        best = total.argmax(1)
        chance = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        some = counts > 0
        names = [langs[b] if s else "und" for b, s in zip(best, some, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], pa.array(names, pa.string()), pa.array(np.where(some, chance, 0.0))], names=[*batch.schema.names[:n_keep], "lang_pred", "score"])


def identify(docs: DataFrame, labelled: DataFrame, model: str, keep: list[str], lang: str = "lang", text: str = "text", order: str = "doc_id") -> DataFrame:
    """The columns ``keep`` of every row, ``lang_pred`` and ``score`` (its share among the learned languages, 0 to 1).

    A null text or one without a letter (Unicode category L; numbers like ½ or Ⅷ are none) is ``und`` with score 0; so is every text when nothing can be learned. Rows
    without a language or text teach nothing. Very long texts are read whole; of languages that tie the first by name is taken. Repeated rows
    give repeated rows; columns not in ``keep`` are not carried, so their names cannot clash. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows, body = with_body(docs, keep, text)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema]
    found = fit(labelled, model, lang, text, order)
    if found is None:
        return rows.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    langs, p, prior = found
    vocab = vocabulary(model)
    shared, name = docs.sparkSession.sparkContext.broadcast(p), uuid.uuid4().hex
    return rows.mapInArrow(lambda it: _predict(it, vocab, shared, langs, prior, name, body, len(keep)), ", ".join([*fields, "lang_pred string", "score double"]))
