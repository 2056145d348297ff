"""Packing token pieces into fixed sequences: best-fit decreasing, then a swap-based local search.

One pass gives every document's token count and the checksum of each piece; only those few numbers are shuffled. Pieces
are dealt by a hash of their row number into groups of bounded size, packed inside a task each, and the pieces of all bins that are
not full are dealt anew and packed again, until one group holds them all or a round needs no fewer bins than the one before.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, stored, texts_of
from .tables import BpeTable, bounds, kept

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = "rid long, " + PIECES + ", sequence_id long, offset long, open boolean"


def _pieces(batches, files: tuple, limit: int, end_id: int):
    table = kept(BpeTable, *files)
    for batch in slices(batches):
        docs = batch.column(0).to_pylist()
        codes, counts = table.documents(texts_of(batch))
        flat, lens = table.ids.take(codes)
        at = bounds(lens, counts)
        rows = []
        for i, doc in enumerate(docs):
            ids = np.append(flat[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4")
            first = len(ids) % limit or limit
            cuts = [0, *range(first, len(ids) + 1, limit)]
            rows.extend((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)))
        doc, piece, start, length, crc = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the longest piece first, each to the fullest bin that still takes it."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room they have left
    sizes: list[int] = []  # rooms that some bin has, in order
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        k = bisect_left(sizes, n)
        if k == len(sizes):
            bins.append([i])
            b, left = len(bins) - 1, capacity - n
        else:
            b, left = room[sizes[k]].pop(), sizes[k] - n
            bins[b].append(i)
            if not room[sizes[k]]:
                del sizes[k]
        if left:
            if not room[left]:
                insort(sizes, left)
            room[left].append(b)
    return bins


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """A bound from below. For each k: pieces too long for one of k share no bin with the pieces of k and more, those above half are alone among
    themselves, and what the others have beyond the room beside them needs bins of its own."""
    x = np.sort(np.asarray(lengths, np.int64))
    total = np.concatenate([[0], np.cumsum(x)])
    k = np.concatenate([[1], np.unique(x[x <= capacity // 2])])
    half = np.searchsorted(x, capacity // 2, "right")
    alone, low = np.searchsorted(x, capacity - k, "right"), np.searchsorted(x, k)
    wide = alone - half
    beyond = (total[half] - total[low]) - (wide * capacity - (total[alone] - total[half]))
    return int((len(x) - half + np.maximum(0, -(-beyond // capacity))).max())


def improve(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Empty the least full bins by moves and exchanges that raise the sum of squared fills.

    A document moves to a fuller bin with room; else it, or a pair, changes places with one shorter document there, so that the
    fuller bin grows. Stops when the bins are as few as ``least_bins`` allows, or when nothing improves: every step raises the sum of
    squares, so there is an end.
    """
    size = lengths.tolist()
    fill = [sum(size[i] for i in b) for b in bins]
    least = least_bins(lengths, capacity)
    changed = True
    while changed:
        alive = sorted((b for b in range(len(bins)) if bins[b]), key=lambda b: fill[b])
        under = [b for b in alive if fill[b] < capacity]
        if len(alive) <= least or len(under) < 2:
            break
        changed = False
        for give in under[: max(1, len(alive) - least)]:
            takers = [b for b in reversed(under) if b != give and bins[b] and fill[b] >= fill[give]]
            for b in takers:
                while bins[give] and fill[b] < capacity:
                    gap = capacity - fill[b]
                    fits = max((i for i in bins[give] if size[i] <= gap), key=size.__getitem__, default=None)
                    step = ([fits], []) if fits is not None else _exchange(bins[give], bins[b], size, gap)
                    if not step:
                        break
                    _shift(bins, fill, size, give, b, *step)
                    changed = True
    return [b for b in bins if b]


def _exchange(own: list[int], other: list[int], size: list[int], gap: int) -> tuple[list[int], list[int]] | None:
    """The exchange that fills the other bin most: one for one, or two for one.

    Equal lengths are alike and a bin of capacity c has at most about sqrt(2 c) different ones, so all pairs of lengths are looked at.
    """
    best, found = 0, None
    theirs = sorted({size[j]: j for j in other}.items())
    lens = [n for n, _ in theirs]
    mine: dict[int, list[int]] = {}
    for i in own:
        mine.setdefault(size[i], []).append(i)

    def look(n: int, give: list[int]) -> None:
        nonlocal best, found
        k = bisect_left(lens, n - gap)
        if k < len(lens) and best < n - lens[k] <= gap:
            best, found = n - lens[k], (give, [theirs[k][1]])

    kinds = sorted(mine)
    for x, n in enumerate(kinds):
        look(n, mine[n][:1])
        if len(mine[n]) > 1:
            look(2 * n, mine[n][:2])
        for m in kinds[x + 1 :]:
            look(n + m, [mine[n][0], mine[m][0]])
        if best == gap:
            break
    return found


def _shift(bins, fill, size, a: int, b: int, out: list[int], back: list[int]) -> None:
    for i in out:
        bins[a].remove(i)
    for j in back:
        bins[b].remove(j)
    bins[b] += out
    bins[a] += back
    d = sum(size[i] for i in out) - sum(size[j] for j in back)
    fill[a] -= d
    fill[b] += d


def _pack_group(key, rows: pd.DataFrame, capacity: int, base: int) -> pd.DataFrame:
    rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32", "rid"], ascending=[False, True, True, True, True], ignore_index=True)
    lengths = rows["length"].to_numpy()
    bins = improve(best_fit(lengths, capacity), lengths, capacity)
    seq, offset, is_open = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64), np.empty(len(rows), bool)
    fills = np.array([lengths[b].sum() for b in bins])
    for k, b in enumerate(bins):
        seq[b] = base + (int(key[0]) << 20) + k
        offset[b] = np.cumsum(lengths[b]) - lengths[b]
        is_open[b] = fills[k] < capacity
    return rows.drop(columns="part").assign(sequence_id=seq, offset=offset, open=is_open)


def _pack(pieces: DataFrame, capacity: int, parts: int, base: int, deal: int) -> DataFrame:
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("rid", F.lit(deal)), F.lit(parts)).cast("int"))
    return dealt.groupBy("part").applyInPandas(lambda key, rows: _pack_group(key, rows, capacity, base), PLACED)


def pieces(docs: DataFrame, files: tuple[str, str, str], limit: int, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of at most ``limit`` tokens of every whole text, ``end_id`` included; only the first piece of a longer text may be shorter."""
    small_batches(docs.sparkSession)
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _pieces(it, files, limit, end_id), PIECES)


def pack(docs: DataFrame, files: tuple[str, str, str], capacity: int = 2048, end_id: int = 0, group_rows: int = 2500, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Place every piece of every document in a sequence of at most ``capacity`` tokens.

    Null text is an empty document (one end token). Very long texts are cut into pieces, none is lost. Null ids, repeated rows, ties
    in length and copies are pieces of their own; rows are dealt by number, so equal ones do not gather in one group. An empty table gives
    no rows; other columns are not carried, so their names cannot clash.
    """
    columns = ["rid", *(c.split()[0] for c in PIECES.split(", "))]
    todo = stored(pieces(docs, files, capacity, end_id, doc_id, text).withColumn("rid", F.monotonically_increasing_id()).select(*columns))
    n, base, deal, done, held, bins = todo.count(), 0, 0, [], None, None
    while n:
        parts = -(-n // group_rows)
        placed = stored(_pack(todo, capacity, parts, base, deal))
        one = placed.where("offset = 0")
        needed = one.count()
        if bins is not None and needed >= bins:  # this deal is no better: the bins stay as they were
            break
        full = needed - one.where("open").count()
        done.append(placed.where("not open"))
        held, bins = placed.where("open"), needed - full
        todo = held.select(*columns)
        n, base, deal = todo.count(), base + (parts << 20), deal + 1
        if parts == 1:
            break
    out = held if held is not None else todo.sparkSession.createDataFrame([], PLACED)
    for more in done:
        out = out.unionByName(more)
    return out.drop("open", "rid")
