"""Near copies of texts: MinHash signatures, an inverted join on their coordinates, exact confirmation.

A document is posted under its coordinate-value pairs. A pair of documents with a match on at least ``need`` of the
``size`` coordinates shares a pair among the ``size - need + 1`` of each that come first in any common order, so only that
prefix is posted, rarest first. Documents that meet under a posting are brought together once for each smallest document of
such a posting. There collisions are counted by merging posting lists with skips: a document's ``need - 1`` longest lists are left out,
as a partner must stand in one of the others; who does is looked up in all lists, and what reaches ``need`` is confirmed on the full
shingle sets. Equal sets are one class from the start.

A meeting too large for one task is first held against its smallest document. Members linked with it need no comparison among
themselves. The rest meet again, and those near enough to reach a linked member (the set distance is a metric) also meet the linked ones. What
is still too large after ``ROUNDS`` of that is cut into blocks that meet in pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_by_key, slices, small_batches, stored, unused
from .components import components
from .shingles import MinHasher, overlap, shingle_sets

#: Documents, and bytes of their shingles, that meet in one task at a time.
BLOCK, BLOCK_BYTES = 1024, 32 << 20
FEW = 16
#: How often large meetings are held against one document before they are cut into pairs of blocks.
ROUNDS = 4
#: Rows of ids that may be broadcast (8 bytes each); above it Spark shuffles both sides.
BROADCAST_ROWS = 1_000_000


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _signed(batches, width: int, size: int, names: list[str]):
    hasher = MinHasher(size)
    for batch in slices(batches):
        sets = shingle_sets(batch.column(1), width)
        full = [i for i, s in enumerate(sets) if len(s)]
        signatures = hasher([sets[i] for i in full]) if full else np.empty((0, size), np.uint32)
        sig, digest = [None] * len(sets), [None] * len(sets)
        for i, row in zip(full, signatures, strict=True):
            sig[i], digest[i] = row.tobytes(), _digest(sets[i])
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), *batch.columns[2:]], names=names)


def _coordinate_keys(column: pa.Array, size: int) -> np.ndarray:
    signatures = np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, size)
    return signatures.astype(np.uint64) | (np.arange(size, dtype=np.uint64) << np.uint64(32))


def _postings(batches, size: int):
    for batch in batches:
        keys = _coordinate_keys(batch.column(2), size)
        node, weight = (np.repeat(batch.column(k).to_numpy(), size) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(node), pa.array(weight)], names=["key", "node", "weight"])


def meetings(nodes: DataFrame, size: int, need: int) -> DataFrame:
    """``hub, node, weight``: documents that share a posting of their prefixes, once for each smallest document of such a posting.

    Pairs that only one document has come first in the order of rarity; they meet nobody and are not posted again. Of the
    rest a document keeps as many as its prefix has left, the rarest.
    """
    total = nodes.count() * size
    postings = nodes.mapInArrow(lambda it: _postings(it, size), "key long, node long, weight long")
    often = stored(postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    shared = joined_by_key(postings, often, "key", total).groupBy("node", "weight").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("x"))  # at most ``size`` each
    room = F.lit(size - need + 1) - (size - F.size("x"))
    first = stored(shared.where(room > 0).select("node", "weight", F.explode(F.slice("x", F.lit(1), room)).alias("y")).select("node", "weight", "y.key"))
    hubs = stored(first.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1"))
    return stored(joined_by_key(first, hubs, "key", total).select("hub", "node", "weight").distinct())


def _sets(batches, width: int, size: int):
    hasher = MinHasher(size)
    for batch in slices(batches):
        sets = shingle_sets(batch.column(1), width)
        full = [i for i, (s, d) in enumerate(zip(sets, batch.column(2).to_pylist(), strict=True)) if len(s) and _digest(s) == d]
        nodes = batch.column(0).to_pylist()
        sig = hasher([sets[i] for i in full]) if full else []
        yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in full], pa.int64()), pa.array([sets[i].tobytes() for i in full], pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary())], names=["node", "shingles", "sig"])


def candidates(signatures: np.ndarray, need: int):
    """For each row the later rows that can have ``need`` collisions with it, and a function that counts them: posting lists merged with skips."""
    n, size = signatures.shape
    hits_of = lambda some, i: (signatures[some] == signatures[i]).sum(1)
    if n <= FEW:  # lists would be longer work than looking at all
        yield from ((i, np.arange(i + 1, n), hits_of) for i in range(n))
        return
    lists, place, length = [], np.empty((n, size), np.int64), np.empty((n, size), np.int64)
    for c in range(size):
        order = np.argsort(signatures[:, c], kind="stable")
        _, start, own, count = np.unique(signatures[order, c], return_index=True, return_inverse=True, return_counts=True)
        lists.append(np.split(order, start[1:]))
        place[order, c], length[order, c] = own, count[own]
    short = np.argsort(length, axis=1, kind="stable")[:, : size - need + 1]
    for i in range(n):
        parts = [x[np.searchsorted(x, i, "right") :] for x in (lists[c][place[i, c]] for c in short[i] if length[i, c] > 1)]
        later = np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int64)
        yield i, later, hits_of


def linked(sets: list[np.ndarray], signatures: np.ndarray, need: int, percent: int, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among some sets (between two sides, if given): pairs with enough collisions, best first, confirmed on the full sets."""
    sizes = np.array([len(s) for s in sets])
    label, out = np.arange(len(sets)), []
    for i, later, hits_of in candidates(signatures, need):
        later = later[(label[later] != label[i]) & (100 * np.minimum(sizes[later], sizes[i]) >= percent * np.maximum(sizes[later], sizes[i]))]
        if sides is not None:
            later = later[sides[later] != sides[i]]
        hits = hits_of(later, i)
        later, hits = later[hits >= need], hits[hits >= need]
        for j in later[np.argsort(-hits, kind="stable")].tolist():
            if label[i] == label[j]:
                continue
            common = overlap(sets[i], sets[j])
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                label[label == label[j]] = label[i]
                out.append((i, j))
    return out


def _meet(rows: pd.DataFrame, need: int, percent: int) -> pd.DataFrame:
    rows = rows.sort_values("node", ignore_index=True)
    sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
    signatures = np.stack([np.frombuffer(s, np.uint32) for s in rows["sig"]])
    node, side = rows["node"].to_numpy(), rows["side"].to_numpy()
    pairs = linked(sets, signatures, need, percent, side if side.min() < side.max() else None)
    return pd.DataFrame({"a": [node[i] for i, _ in pairs], "b": [node[j] for _, j in pairs]}, dtype=np.int64)


def _against_one(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Every member of a slice against the meeting's one: 0 linked, 1 near enough to reach one that is linked, 2 beyond that."""
    first, rest = rows[rows["first"]], rows[~rows["first"]]
    one = np.frombuffer(first["shingles"].iloc[0], np.uint64)
    zone = np.full(len(rest), 2)
    for k, s in enumerate(rest["shingles"]):
        x = np.frombuffer(s, np.uint64)
        common = overlap(one, x)
        union = len(one) + len(x) - common
        zone[k] = 0 if 100 * common >= percent * union else 1 if 100 * common >= (2 * percent - 100) * union else 2
    return pd.DataFrame({"hub": rest["hub"], "node": rest["node"], "weight": rest["weight"], "one": first["node"].iloc[0], "zone": zone})


def _large(members: DataFrame) -> DataFrame:
    """``hub, n, blocks, one`` of the meetings that are too large for one task; ``one``: the smallest member."""
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("weight") * 8 / BLOCK_BYTES)).cast("int")
    return stored(members.groupBy("hub").agg(F.count("*").alias("n"), blocks.alias("blocks"), F.min("node").alias("one")).where("blocks > 1 and n > 1"))


def _in_pairs(members: DataFrame, large: DataFrame, total: int) -> DataFrame:
    """``hub, lo, hi, node, side``: blocks of one meeting in pairs."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = joined_by_key(members, large, "hub", total).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.where("other <> own or blocks = 1").select("hub", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", F.lit(0).alias("side"))


def _two_sides(zones: DataFrame) -> DataFrame:
    """The same for the linked members of a meeting and those near enough to reach one: every block of the one side with every block of the other."""
    room = lambda zone: F.greatest(F.ceil(F.count_if(F.col("zone") == zone) / BLOCK), F.ceil(F.sum(F.when(F.col("zone") == zone, F.col("weight"))) * 8 / BLOCK_BYTES)).cast("int")
    parts = stored(zones.groupBy("hub").agg(F.count("*").alias("n"), room(0).alias("p"), room(1).alias("q")).where("p > 0 and q > 0"))
    total = zones.count()
    rows = joined_by_key(zones.where("zone < 2").select("hub", "node", "zone"), parts, "hub", total)
    own = F.pmod(F.xxhash64("node"), F.when(F.col("zone") == 0, F.col("p")).otherwise(F.col("q"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("zone") == 0, F.col("q")).otherwise(F.col("p")) - 1))
    rows = rows.withColumn("own", own).withColumn("other", other)
    first = F.col("zone") == 0
    return rows.select("hub", F.when(first, F.col("own")).otherwise(F.col("other")).alias("lo"), (-1 - F.when(first, F.col("other")).otherwise(F.col("own"))).alias("hi"), "node", F.col("zone").alias("side"))


def _meeting_links(members: DataFrame, sets: DataFrame, need: int, percent: int) -> DataFrame:
    """Links (``a``, ``b``) of all meetings."""
    links, dealt, todo = [], [], members
    for k in range(ROUNDS + 1):
        large, total = _large(todo), todo.count()
        few = large.count()
        small = todo.join(F.broadcast(large.select("hub")) if few <= BROADCAST_ROWS else large.select("hub"), "hub", "left_anti")
        dealt.append(small.select(F.lit(k).alias("salt"), "hub", F.lit(0).alias("lo"), F.lit(0).alias("hi"), "node", F.lit(0).alias("side")))
        if not few:
            break
        if k == ROUNDS:
            dealt.append(_in_pairs(todo, large, total).select(F.lit(1000 + k).alias("salt"), "hub", "lo", "hi", "node", "side"))
            break
        rows = joined_by_key(todo, large, "hub", total)
        slices = rows.where("node <> one").select("hub", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("slice"), "node", "weight", F.lit(False).alias("first"))
        ones = large.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("slice"), F.col("one").alias("node"), F.lit(0).cast("long").alias("weight"), F.lit(True).alias("first"))
        every = slices.union(ones).join(sets.select("node", "shingles"), "node")
        zones = stored(every.groupBy("hub", "slice").applyInPandas(lambda rows: _against_one(rows, percent), "hub long, node long, weight long, one long, zone int"))
        links.append(zones.where("zone = 0").select(F.col("one").alias("a"), F.col("node").alias("b")))
        dealt.append(_two_sides(zones).select(F.lit(2000 + k).alias("salt"), "hub", "lo", "hi", "node", "side"))
        todo = stored(zones.where("zone > 0").select("hub", "node", "weight"))
    rows = dealt[0]
    for more in dealt[1:]:
        rows = rows.unionByName(more)
    out = rows.join(sets, "node").groupBy("salt", "hub", "lo", "hi").applyInPandas(lambda rows: _meet(rows, need, percent), "a long, b long")
    for more in links:
        out = out.unionByName(more)
    return out


def near_copies(docs: DataFrame, width: int = 5, percent: int = 80, size: int = 32, need: int = 14, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles``, ``component_id`` (smallest linked id), ``kept``, ``first``, ``class_id``, and the columns ``keep`` as they are.

    Two texts are linked when 100 * common shingles >= ``percent`` * all their shingles. With ``size`` 32 and ``need`` 14 a pair
    right at 80 % falls below ``need`` collisions about twice in a million; every pair that reaches it is confirmed exactly.
    What is compared is sets of shingles, each a class (``class_id``) of the rows that have it; ids come in at the end, so rows that share an id are
    judged by their own texts. ``kept`` is ``doc_id = component_id``; ``first`` marks the rows of one class of each component, that of the smallest id
    (then the smallest class), also where ids repeat. Null texts and texts without words link with nothing, have no class, are kept and first;
    very long ones are read whole. A row without an id cannot be named: it links with nothing, its component is null and it is kept and first. A pair
    right at ``percent`` is a link. Empty tables give no rows; columns not in ``keep`` are not carried, so their names cannot clash.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    more = docs.select(*(keep or [])).schema.fields
    extra = [unused(f"more{k}", ["doc_id", "text"]) for k in range(len(more))]
    wide = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"), *(docs[f.name].alias(x) for f, x in zip(more, extra, strict=True)))
    kinds = ["doc_id long", "n_shingles long", "digest binary", "sig binary", *(f"{x} {f.dataType.simpleString()}" for f, x in zip(more, extra, strict=True))]
    names = [k.split()[0] for k in kinds]
    signed = stored(wide.mapInArrow(lambda it: _signed(it, width, size, names), ", ".join(kinds)))
    named = signed.where(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
    classes = named.groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("weight"), F.first("sig").alias("sig"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()))  # any number of its own; written, so it stays
    members = meetings(classes.select("node", "weight", "sig"), size, need)
    wanted = stored(members.select("node").distinct().join(classes.select("node", "digest", F.col("least").alias("doc_id")), "node"))
    count = wanted.count()
    side = F.broadcast(wanted) if count <= BROADCAST_ROWS else wanted
    sets = stored(rows.join(side, "doc_id").select("node", "text", "digest").mapInArrow(lambda it: _sets(it, width, size), "node long, shingles binary, sig binary"))
    if sets.count() > count:  # repeated rows
        sets = stored(sets.dropDuplicates(["node"]))
    joined = stored(components(stored(_meeting_links(members, sets, need, percent)), "a", "b").join(classes.select("node", "digest", "least"), "node"))
    firsts = stored(joined.groupBy("component").agg(F.count("*").alias("n"), F.min(F.struct("least", "digest")).alias("head")))
    heads = joined_by_key(joined.select("component", "digest"), firsts, "component", joined.count()).select("digest", "head")
    every = classes.join(heads, "digest", "left").select("digest", F.coalesce("head.least", "least").alias("component"), F.coalesce("head.digest", "digest").alias("head"))

    out = signed.join(every, "digest", "left")
    unnamed = F.col("doc_id").isNull()
    component = F.when(~unnamed, F.coalesce("component", "doc_id"))
    first = unnamed | F.col("digest").isNull() | ((F.col("doc_id") == F.col("component")) & (F.col("digest") == F.col("head")))
    out = out.select("doc_id", "n_shingles", component.cast("long").alias("component_id"), first.alias("first"), F.when(~unnamed, F.hex("digest")).alias("class_id"), *(F.col(x).alias(f.name) for f, x in zip(more, extra, strict=True)))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
