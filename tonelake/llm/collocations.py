"""Phrase collocations: frequent phrases found with mergeable Misra-Gries summaries, counted exactly in a second pass, scored and ranked.

A phrase's hash gives its partition. A task summarises the phrases of its texts for each partition; the summaries of a partition are merged, many at once, into
one whose counters outnumber its mass over the threshold: what is taken off a counter stays below the threshold, so every frequent phrase keeps one.
What can reach the threshold by its counter and that loss goes into a bit map of fixed size; the second pass counts by their words the phrases whose bits are set, and
drops what is too rare. Phrases of three and four words are summarised only where all their pairs of neighbours have their bits, as a
phrase is not more frequent than its parts.

All counts are sums over the whole corpus, combined within tasks before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_by_key, slices, small_batches, stored
from .shingles import BYTE, LOWER, flat_bytes, mixed, powers

LONGEST = 4


class Limits(NamedTuple):
    """Sizes of what a task holds; none changes a result."""

    #: Bits of the map (a byte for eight): about this many phrases can be told from others; with more the second pass only counts more.
    map_bits: int = 27
    #: Phrases that a task summarises or counts, and counters of a merged summary, before they are passed on or cut.
    held: int = 1 << 20
    counters: int = 1 << 20
    #: Bytes of text that are counted together.
    text: int = 3 << 20


LIMITS = Limits()
_CUT = np.isin(np.arange(256), list(b".,;:!?\n\x0b\x0c\r"))
_BETWEEN = _CUT | np.isin(np.arange(256), list(b" \t"))
#: Tables for ``bytes.translate``, which is faster than an index for each byte. Kinds: 0 in a word, 1 between words, 2 between pieces.
_END = pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())
_LOWER, _KIND = LOWER.tobytes(), (_BETWEEN.astype(np.uint8) + _CUT).tobytes()
#: What of eight bytes, the first lowest, belongs to a word of so many.
_OF_EIGHT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    x ^= x >> np.uint64(32)
    return x * _MIX


def _binary(data: np.ndarray, lens: np.ndarray) -> pa.Array:
    """Byte strings of these lengths, from their bytes one after another."""
    return pa.Array.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(np.append(0, np.cumsum(lens))), pa.py_buffer(np.ascontiguousarray(data))])


class Words:
    """The words of a slice of texts, in order: place and length in the bytes, text, piece, and a hash. A-Z are in lower case."""

    def __init__(self, column: pa.Array):
        ended = pc.binary_join_element_wise(pc.fill_null(column, "").cast(pa.large_string()), *_END)  # so no piece goes on in the next text
        data, offsets = flat_bytes(ended)
        data = data.tobytes()
        kind = np.frombuffer(data.translate(_KIND), np.uint8)
        outside = np.append(True, kind > 0)  # one place later
        cut = kind == 2
        marks = np.flatnonzero(cut | (outside[:-1] & ~outside[1:]))
        cuts = cut[marks]
        self.starts = marks[~cuts]
        self.lens = np.flatnonzero(outside[1:] & ~outside[:-1]) - self.starts
        #: Whether a word is the first of its piece.
        self.first = np.append(True, cuts[:-1])[: len(cuts)][~cuts]
        self.text = np.repeat(np.arange(len(column)), np.diff(np.searchsorted(self.starts, offsets)))
        data = data.translate(_LOWER) + bytes(16)
        self.data = np.frombuffer(data, np.uint8)
        self._eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        self.hash = self._hashes()

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def piece(self) -> np.ndarray:
        return np.cumsum(self.first) - 1

    def _bytes(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of some words one after another, the place of each in its word, and where each word begins."""
        lens = self.lens[some]
        begin = np.cumsum(lens) - lens
        place = np.arange(int(lens.sum()), dtype=np.int32) - np.repeat(begin, lens).astype(np.int32)
        return self.data[np.repeat(self.starts[some], lens) + place], place, begin

    def _block(self, some: np.ndarray, k: int) -> np.ndarray:
        """Eight bytes of some words, from byte ``8 * k`` on, which all of them have."""
        return self._eight[self.starts[some] + 8 * k] & _OF_EIGHT[np.minimum(self.lens[some] - 8 * k, 8)]

    def _hashes(self) -> np.ndarray:
        h = mixed(self._block(np.arange(len(self)), 0) ^ (self.lens.astype(np.uint64) * _MIX))
        more = np.flatnonzero(self.lens > 8)
        h[more] = mixed(h[more] * _MIX ^ self._block(more, 1))
        long = more[self.lens[more] > 16]
        if len(long):
            data, place, begin = self._bytes(long)
            h[long] = mixed(np.add.reduceat(BYTE[data] * powers(int(self.lens[long].max()))[place], begin) + self.lens[long].astype(np.uint64))
        return h

    def vocabulary(self, some: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """A number for each word of ``some``, and the word of each number. Words are told apart by all of their bytes, not by hashes."""
        lens = self.lens[some]
        brief = lens < 8
        number = np.empty(len(some), np.int64)
        few = some if brief.all() else some[brief]
        whole = (self._block(few, 0) | (self.lens[few].astype(np.uint64) << np.uint64(56))).view(np.int64)  # up to seven bytes and their number
        codes = pa.array(whole).dictionary_encode()
        number[brief] = codes.indices.to_numpy()
        sevens = codes.dictionary.to_numpy().view(np.uint8).reshape(-1, 8)
        size, data = sevens[:, 7].astype(np.int64), sevens[np.arange(8) < sevens[:, 7:]]
        names = [_binary(data, size)]
        if len(few) < len(some):
            longer = some[~brief]
            codes = _binary(self._bytes(longer)[0], self.lens[longer]).dictionary_encode()
            number[~brief] = codes.indices.to_numpy() + len(size)
            names.append(codes.dictionary)
        return number, pa.concat_arrays(names).cast(pa.large_string())

    def numbered(self) -> tuple[np.ndarray, list[str]]:
        """A number for each word, and the word of each number."""
        number, names = self.vocabulary(np.arange(len(self)))
        return number, names.to_pylist()

    def phrases(self, seed: np.ndarray, longest: int = LONGEST) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For 1 to ``longest`` words: length, the words that begin such phrases, and their hashes. ``seed``: a number for the language of each text."""
        h, go = _mixed(self.hash ^ seed[self.text]) if len(self) else self.hash, np.ones(len(self), bool)
        for width in range(1, longest + 1):
            if width > 1:
                go = go[:-1] & ~self.first[width - 1 :]
                h = _mixed(h[:-1] ^ (self.hash[width - 1 :] + np.uint64(width)))
            yield width, np.flatnonzero(go), h[go]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in their order, and the sum of each one's counts."""
    if keys.dtype == np.uint32 and len(counts) and counts.max() < 1 << 32:  # both in one number, which is sorted faster
        both = np.sort((keys.astype(np.uint64) << np.uint64(32)) | counts.astype(np.uint64))
        keys, counts = (both >> np.uint64(32)).astype(np.uint32), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Summary:
    """Misra-Gries counters of hashes, with the most that any counter lacks (``error``, kept below ``threshold``)."""

    def __init__(self, threshold: int, capacity: int = LIMITS.counters):
        self.threshold, self.capacity, self.error = threshold, capacity, 0
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Merge in keys with counts (of other summaries without error; a key may stand there more than once)."""
        if not len(self.keys):
            self.keys = self.keys.astype(keys.dtype)
        self.keys, self.counts = _summed(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        while len(self.keys) > self.capacity:
            least = int(np.partition(self.counts, len(self.keys) - self.capacity - 1)[len(self.keys) - self.capacity - 1])
            if self.error + least >= self.threshold:  # more mass than the counters are for: more counters
                self.capacity *= 2
                continue
            self.error += least
            left = self.counts > least
            self.keys, self.counts = self.keys[left], self.counts[left] - least


def _seeds(langs: list[str]) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(x.encode(), digest_size=8, person=b"lang").digest() for x in langs), np.uint64)


def _languages(batch: pa.RecordBatch) -> tuple[np.ndarray, list[str]]:
    """The number of the language of each row, and the names."""
    lang = batch.column(0).dictionary_encode()
    return lang.indices.to_numpy().astype(np.int64), lang.dictionary.to_pylist()


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h >> np.uint64(64 - (8 * len(bits)).bit_length() + 1)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def _summarised(batches, widths: tuple[int, ...], known, cut: int, limits: Limits):
    """``part, keys, counts``: for each partition (of ``1 << cut``) the phrases of a task and their counts; keys are the 32 bits below the partition's."""
    found, size = [], 0
    bits = known.value if known is not None else None

    def rows():
        keys = np.sort(np.concatenate(found) >> np.uint64(32 - cut))
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        keys, counts = keys[first], np.diff(np.append(first, len(keys)))
        bounds = np.searchsorted(keys, np.arange((1 << cut) + 1, dtype=np.uint64) << np.uint64(32)).tolist()
        keys = keys.astype(np.uint32)
        for p, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if i < j:
                yield p, keys[i:j].tobytes(), _small(counts[i:j])

    def made():
        part, keys, counts = zip(*rows(), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], names=["part", "keys", "counts"])

    for batch in slices(batches, size=limits.text):
        words, (lang, names) = Words(batch.column(1)), _languages(batch)
        whole = None
        for width, at, h in words.phrases(_seeds(names)[lang], max(widths)):
            if bits is not None and width == 2:
                whole = np.zeros(len(words), bool)
                whole[at[_has(bits, h)]] = True
            if width in widths:
                if whole is not None and width > 2:
                    h = h[np.logical_and.reduce([whole[at + k] for k in range(width - 1)])]
                if len(h):
                    found.append(h)
                    size += len(h)
        if size > limits.held:
            yield made()
            found, size = [], 0
    if found:
        yield made()


def _survivors(batches, threshold: int, cut: int, limits: Limits):
    """``part, bits``: of each partition the part of the bit map with the phrases that can reach the threshold."""
    now, summary, waiting, size = None, None, [], 0

    def add():
        keys, counts = zip(*waiting, strict=True)
        summary.add(np.frombuffer(b"".join(keys), np.uint32), _numbers(counts, [len(k) // 4 for k in keys]))

    def row():
        width = limits.map_bits - cut
        may = summary.counts + summary.error >= threshold  # a counter lacks ``error`` at most
        flags = np.zeros(1 << width, np.uint8)
        flags[summary.keys[may] >> np.uint32(32 - width)] = 1
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

    for batch in batches:
        for part, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part != now or size > limits.counters:  # as many keys as the summary holds are merged at once: a merge costs as much for a few
                if waiting:
                    add()
                waiting, size = [], 0
            if part != now:
                if now is not None:
                    yield row()
                now, summary = part, Summary(threshold, limits.counters)
            waiting.append((keys, counts))
            size += len(keys) // 4
    if now is not None:
        add()
        yield row()


def frequent_bits(rows: DataFrame, widths: tuple[int, ...], threshold: int, mass: int, known=None, limits: Limits = LIMITS) -> np.ndarray:
    """Bit map of the phrases of these lengths that may stand ``threshold`` times or more: all that do, and few others."""
    spark = rows.sparkSession
    cut = _cut(spark, mass * len(widths), threshold, limits)
    made = rows.mapInArrow(lambda it: _summarised(it, widths, known, cut, limits), "part int, keys binary, counts binary")
    dealt = made.repartition(min(1 << cut, 4096), "part").sortWithinPartitions("part")
    out = np.zeros(1 << (limits.map_bits - 3), np.uint8)
    size = len(out) >> cut
    # all parts together are as large as the map; a local iterator would run one task after another
    for row in dealt.mapInArrow(lambda it: _survivors(it, threshold, cut, limits), "part int, bits binary").collect():
        out[row["part"] * size : (row["part"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return out


def _small(n: np.ndarray) -> bytes:
    """Numbers, a byte each if that is enough."""
    return n.astype(np.uint8 if not len(n) or n.max() < 256 else np.int64).tobytes()


def _numbers(data: list[bytes], sizes: list[int]) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, np.uint8 if len(x) == n else np.int64).astype(np.int64) for x, n in zip(data, sizes, strict=True)])


def _grouped(table: pa.Table, keys: list[str]) -> pa.Table:
    """The sum of ``n`` for each key."""
    return table.group_by(keys, use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select([*keys, "n"]).combine_chunks()


def _exact(batches, known, cut: int, limits: Limits):
    """``part, size, keys, lens, counts``: for each partition (of ``1 << cut``) so many phrases whose bit is set, one after another, and their counts in many slices.

    A key is the phrase, a line feed, which no word holds, and the language; without a phrase it stands for all words.
    A phrase is known by the numbers of its words, which stand for their bytes: hashes only choose what is counted, and the partition.
    """
    bits = known.value
    columns = ["lang", *map(str, range(LONGEST)), "part"]
    none = pa.array([""], pa.large_string())  # number 0
    kept, size, names = [], 0, [none]

    def summed():
        """One row a phrase, and one number a word or language."""
        every = pa.concat_arrays(names).dictionary_encode()
        table = pa.concat_tables(kept)
        table = pa.table([every.indices.take(table[c].combine_chunks()) for c in columns[:-1]] + [table["part"], table["n"]], [*columns, "n"])
        return [_grouped(table, columns)], [every.dictionary]

    def made():
        (table,), (texts,) = summed()
        part = table["part"].to_numpy()
        order = np.argsort(part, kind="stable")
        table, part = table.take(pa.array(order)), part[order]
        words = [table[str(k)].combine_chunks() for k in range(LONGEST)]
        parts = [texts.take(w if k == 0 else pc.if_else(pc.equal(w, 0), pa.scalar(None, w.type), w)) for k, w in enumerate(words)]
        phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", texts.type), null_handling="skip")
        keys = pc.binary_join_element_wise(phrase, texts.take(table["lang"].combine_chunks()), pa.scalar("\n", texts.type))
        data, ends = flat_bytes(keys)
        counts, lens = table["n"].to_numpy(), np.diff(ends)
        bounds = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
        spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
        for k in range(0, len(spans), 64):
            some = spans[k : k + 64]
            columns_of = [pa.array([part[i] for i, _ in some], pa.int32()), pa.array([j - i for i, j in some], pa.int32())]
            columns_of += [pa.array([f(x) for x in some], pa.binary()) for f in (lambda x: data[ends[x[0]] : ends[x[1]]].tobytes(), lambda x: _small(lens[x[0] : x[1]]), lambda x: _small(counts[x[0] : x[1]]))]
            yield pa.RecordBatch.from_arrays(columns_of, names=["part", "size", "keys", "lens", "counts"])

    for batch in slices(batches, size=limits.text):
        words, (lang, own) = Words(batch.column(1)), _languages(batch)
        lang_at = lang[words.text]
        found, before = [], np.ones(len(words) + 1, bool)
        parts = [np.zeros(len(own), np.int32)]
        for width, at, h in words.phrases(_seeds(own)[lang]):
            may = before[at] & before[at + 1]  # no phrase is more frequent than its parts
            may[may] = _has(bits, h[may])
            before = np.zeros(len(words), bool)
            before[at[may]] = True
            found.append((at[may], (h[may] >> np.uint64(64 - cut)).astype(np.int32)))
        some = found[0][0]
        number = np.empty(len(words), np.int64)
        number[some], texts = words.vocabulary(some)
        base = sum(map(len, names))
        names += [pa.array(own, texts.type), texts]
        rows = [np.zeros((len(own), LONGEST + 2), np.int64)]
        rows[0][:, 0], rows[0][:, -1] = base + np.arange(len(own)), np.bincount(lang_at, minlength=len(own))
        code, before = lang_at, rows[0]
        for width, (at, p) in enumerate(found, 1):  # a phrase is the one without its last word, and this word
            keys = pa.array(code[at] * len(texts) + number[at + width - 1]).dictionary_encode()
            code[at] = keys.indices.to_numpy()
            first, last = np.divmod(keys.dictionary.to_numpy(), max(1, len(texts)))
            before = before[first]
            before[:, width], before[:, -1] = base + len(own) + last, np.bincount(keys.indices.to_numpy(), minlength=len(first))
            rows.append(before)
            part = np.empty(len(first), np.int32)
            part[code[at]] = p  # the same for all of a phrase
            parts.append(part)
        rows = np.concatenate(rows)
        kept.append(pa.table([pa.array(x.astype(np.int32)) for x in rows.T[:-1]] + [pa.array(np.concatenate(parts)), pa.array(rows[:, -1])], [*columns, "n"]))
        size += len(rows)
        if size > limits.held:
            kept, names = summed()
            size = len(kept[0])
            if size > limits.held // 2:
                yield from made()
                kept, size, names = [], 0, [none]
    if kept:
        yield from made()


def _totals(batches, threshold: int, limits: Limits):
    """``lang, width, phrase, f`` of the phrases of each partition that reach the threshold, and of width 0."""
    now, done, waiting, size = None, None, [], 0

    def summed():
        sizes, keys, lens, counts = zip(*waiting, strict=True)
        table = pa.table([_binary(np.frombuffer(b"".join(keys), np.uint8), _numbers(lens, sizes)), pa.array(_numbers(counts, sizes))], ["key", "n"])
        return _grouped(table if done is None else pa.concat_tables([done, table]), ["key"])

    def rows():
        for batch in summed().to_batches(1 << 14):
            key = pc.split_pattern(batch.column(0).cast(pa.large_string()), "\n", max_splits=1).flatten()
            phrase, lang = (key.take(pa.array(np.arange(k, len(key), 2))).cast(pa.string()) for k in (0, 1))
            width = pc.if_else(pc.equal(phrase, ""), 0, pc.add(pc.count_substring(phrase, " "), 1)).cast(pa.int32())
            out = pa.RecordBatch.from_arrays([lang, width, phrase, batch.column(1)], names=["lang", "width", "phrase", "f"])
            yield out.filter(pc.or_(pc.greater_equal(out.column(3), threshold), pc.equal(width, 0)))

    for batch in batches:
        for part, *block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part != now and waiting:
                yield from rows()
                done, waiting, size = None, [], 0
            now = part
            if size > max(limits.held, 0 if done is None else len(done)):
                done, waiting, size = summed(), [], 0
            waiting.append(block)
            size += block[0]
    if waiting:
        yield from rows()


def _cut(spark, mass: int, threshold: int, limits: Limits) -> int:
    """Bits of a hash that choose a partition, so that the counters suffice for the mass of each."""
    need = mass // threshold // limits.counters
    return min(limits.map_bits - 3, max(need, spark.sparkContext.defaultParallelism).bit_length() + 1)


def phrase_counts(docs: DataFrame, threshold: int, lang: str = "lang", text: str = "text", limits: Limits = LIMITS) -> tuple[DataFrame, DataFrame]:
    """``lang, width, phrase, f`` of every phrase of 1 to 4 words with ``threshold`` occurrences in a language, and ``lang, n``: all its words."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), docs[text].cast("string").alias("text"))
    mass = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    mass = mass // 2 + 1  # a word has a byte at least and one behind it
    short = frequent_bits(rows, (1, 2), threshold, mass, None, limits)
    pairs = spark.sparkContext.broadcast(short)
    long = frequent_bits(rows, (3, 4), threshold, mass, pairs, limits)
    known = spark.sparkContext.broadcast(short | long)
    cut = _cut(spark, mass * LONGEST, threshold, limits)
    counted = rows.mapInArrow(lambda it: _exact(it, known, cut, limits), "part int, size int, keys binary, lens binary, counts binary")
    dealt = counted.repartition(min(1 << cut, 4096), "part").sortWithinPartitions("part")
    counts = stored(dealt.mapInArrow(lambda it: _totals(it, threshold, limits), "lang string, width int, phrase string, f long"))
    return counts.where("width > 0"), counts.where("width = 0").select("lang", F.col("f").alias("n"))


def _sub(first, width):
    """Words ``first`` (from 1) on, ``width`` of them, of the column ``words``."""
    return F.array_join(F.slice("words", first, width), " ")


def scored(counts: DataFrame, share: int = 80) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of the phrases of two words or more that no longer phrase stands in for with ``share`` percent of their count."""
    words = counts.where("width > 1").withColumn("words", F.split("phrase", " "))
    cuts = words.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("width") - 1)).alias("k"), "words", "width")
    cuts = cuts.select("lang", "phrase", "a", "k", F.struct("lang", _sub(F.lit(1), F.col("k")).alias("phrase")).alias("left"), F.struct("lang", _sub(F.col("k") + 1, F.col("width") - F.col("k")).alias("phrase")).alias("right"))
    cuts = stored(cuts)
    total = cuts.count()
    f = counts.select(F.struct("lang", "phrase").alias("key"), "f")
    for side, name in (("left", "l"), ("right", "r")):
        keys = stored(cuts.groupBy(side).agg(F.count("*").alias("n")).join(f.withColumnRenamed("key", side), side).withColumnRenamed("f", name))
        cuts = joined_by_key(cuts, keys, side, total).drop("n", side)
    value = F.expr("(2000000 * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    best = cuts.withColumn("score", value).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("x")).select("lang", "phrase", "x.*").drop("k")
    inner = words.where("width > 2").select("lang", "f", "words", "width", F.explode(F.sequence(F.lit(2), F.col("width") - 1)).alias("w"))
    inner = inner.select("lang", "f", "words", "w", F.explode(F.sequence(F.lit(1), F.col("width") - F.col("w") + 1)).alias("at"))
    longer = inner.select("lang", _sub(F.col("at"), F.col("w")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    found = best.join(longer, ["lang", "phrase"], "left")
    return found.where(F.col("longer").isNull() | (F.lit(100).cast("decimal(20,0)") * F.col("longer") < F.lit(share).cast("decimal(20,0)") * F.col("a"))).drop("longer")


def collocations(docs: DataFrame, threshold: int = 30, top: int = 2000, lang: str = "lang", text: str = "text", limits: Limits = LIMITS) -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Phrases have 2 to 4 words and ``threshold`` occurrences. A phrase's score is that of its weakest cut into two parts: 2,000,000 times its count over the
    sum of theirs, rounded down (of equal ones the first cut). A phrase within a longer one with 80 % of its count is left out. Equal scores stand by count,
    then by the bytes of the phrase. A null language is ``und``; null and empty texts have no words; very long texts are read whole. Repeated rows
    count each time; other columns are not carried, so their names cannot clash. An empty table gives no rows.
    """
    from pyspark.sql import Window

    small_batches(docs.sparkSession)
    counts, sizes = phrase_counts(docs, threshold, lang, text, limits)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = stored(scored(counts)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return first.join(F.broadcast(sizes), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
