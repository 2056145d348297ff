"""Near copies of embedding vectors: inverted lists, product-quantised residuals, exact rerank.

Coarse centroids and residual codebooks are fitted on a bounded sample; every vector is then indexed. A query
probes every list that can hold a partner: a vector within distance r of the query lies in list c only if the query is within
r of the plane between its own centroid and c. In a probed list the asymmetric distance to a code is off by at most the code's
stored error, so codes farther than r plus that error are passed over, and the rest are compared by exact cosine. Both bounds hold
for every pair, so no link is lost. Equal vectors are one class. Each label's lists are put together or cut into blocks. A vector asks in its own
block and in those after it that hold a list it probes; what is asked of a block is cut into slices, and the block meets each of them.
So what is shipped grows with the probes. There both sides' partners are counted and links that join are reported, never all pairs.
"""

from __future__ import annotations

import math
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_by_key, small_batches, stored
from .components import components

#: Vectors that the index is fitted on, and lists, at most; below that a list for every ``PER_LIST`` vectors.
SAMPLE, LISTS, PER_LIST = 16_384, 2048, 32
BLOCK = 1024
SUBSPACES, CODES = 8, 64
SLACK = 1e-6


def _usable(batches):
    """Vectors as bytes of doubles; None where a vector is null, zero or holds null or non-finite components.

    They are scaled by a power of two, which changes no cosine, so that squares neither overflow nor vanish.
    """
    for batch in batches:
        out = []
        for v in batch.column(2).to_pylist():
            x = None if not v or None in v else np.asarray(v, np.float64)
            top = 0.0 if x is None else float(np.abs(x).max())
            out.append(np.ldexp(x, -math.frexp(top)[1]).tobytes() if top > 0 and math.isfinite(top) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["vec_id", "label", "vec"])


def _unit(column) -> np.ndarray:
    x = np.stack([np.frombuffer(v, np.float64) for v in column])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _sq(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centre of each vector, some vectors at a time."""
    return np.concatenate([_sq(x[k : k + 1024], c).argmin(1) for k in range(0, len(x), 1024)])


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        home = _nearest(x, centres)
        total = np.zeros_like(centres)
        np.add.at(total, home, x)
        n = np.bincount(home, minlength=len(centres))
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


class Index:
    """Coarse centroids and one codebook for each subspace of the residuals."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centres = _kmeans(sample, min(lists, len(sample)), 1)
        rest = sample - self.centres[_nearest(sample, self.centres)]
        self.cuts = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
        self.books = [_kmeans(rest[:, a:b], min(CODES, len(rest)), 2 + k) for k, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True))]

    @cached_property
    def apart(self) -> np.ndarray:
        """Distances between the centres: computed once in a Python worker, and never shipped with the index."""
        return np.sqrt(_sq(self.centres, self.centres))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, code and the distance between the vector and what its code stands for."""
        home = _nearest(x, self.centres)
        rest = x - self.centres[home]
        code = np.stack([_sq(rest[:, a:b], book).argmin(1) for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)], 1).astype(np.uint8)
        return home, code, np.linalg.norm(rest - self.decode(code), axis=1)

    def decode(self, code: np.ndarray) -> np.ndarray:
        return np.concatenate([book[code[:, k]] for k, book in enumerate(self.books)], 1)

    def probes(self, x: np.ndarray, radius: float) -> np.ndarray:
        """Which lists can hold a vector within ``radius``."""
        d = _sq(x, self.centres)
        home = d.argmin(1)
        over = d - d[np.arange(len(x)), home][:, None]
        return over <= 2 * self.apart[home] * (radius + SLACK)

    def distances(self, x: np.ndarray, home: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Squared asymmetric distances of every query to every code, by table look-ups."""
        c = self.centres[home]
        # |x - c - r|^2 = |x - c|^2 - 2 x.r + 2 c.r + |r|^2, with x.r and |r|^2 from tables
        dots = np.zeros((len(x), len(code)))
        own = np.zeros(len(code))
        for k, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)):
            book = self.books[k]
            dots += (x[:, a:b] @ book.T)[:, code[:, k]]
            own += (book * book).sum(1)[code[:, k]] + 2 * (c[:, a:b] * book[code[:, k]]).sum(1)
        return _sq(x, c) - 2 * dots + own[None, :]


INDEXED = "node long, label string, vec binary, copies long, cell int, code binary, off double, team int, probes array<int>"


def _indexed(batches, shared, radius: float):
    index = shared.value
    lists = len(index.centres)
    for batch in batches:
        x = _unit(batch.column(2).to_pylist())
        home, code, off = index.encode(x)
        teams = batch.column(4).to_numpy()
        # lists that stand together are one team; a vector asks a team once, however many of its lists it probes
        asked = pa.array([np.unique(np.flatnonzero(p) * t // lists).astype(np.int32) for p, t in zip(index.probes(x, radius), teams, strict=True)], pa.list_(pa.int32()))
        out = [*batch.columns[:4], pa.array(home, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(off), pa.array(home * teams // lists, pa.int32()), asked]
        yield pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in INDEXED.split(", ")])


def _compare(key, rows: pd.DataFrame, shared, cosine: float) -> pd.DataFrame:
    index, radius = shared.value, math.sqrt(2 - 2 * cosine)
    asks = rows[rows["ask"]].sort_values("node", ignore_index=True)
    held = rows[~rows["ask"]].sort_values("node", ignore_index=True)
    out = {"a": [], "b": [], "links": []}
    if len(asks) and len(held):
        x, y = _unit(asks["vec"]), _unit(held["vec"])
        home = held["cell"].to_numpy()
        code = np.stack([np.frombuffer(c, np.uint8) for c in held["code"]])
        near = index.probes(x, radius)[:, home]
        reach = radius + held["off"].to_numpy() + SLACK
        near &= index.distances(x, home, code) <= (reach * reach)[None, :] + SLACK
        node, other, copies = asks["node"].to_numpy(), held["node"].to_numpy(), held["copies"].to_numpy()
        same = asks["vec"].to_numpy()[:, None] == held["vec"].to_numpy()[None, :]
        q, p = np.nonzero(near & ~same)
        exact = np.concatenate([np.einsum("ij,ij->i", x[q[i : i + 65536]], y[p[i : i + 65536]]) for i in range(0, len(q), 65536)]) if len(q) else np.empty(0)
        q, p = q[exact >= cosine], p[exact >= cosine]
        if len(q):
            linked = np.zeros((len(x), len(y)), bool)
            linked[q, p] = True
            # a vector of this block asks for itself; one of another block counts for both
            guests = np.where(asks["own"].to_numpy() != key[1], asks["copies"].to_numpy(), 0)
            for ids, n in ((node, linked @ copies), (other, guests @ linked)):
                some = np.flatnonzero(n)
                out["a"] += ids[some].tolist()
                out["b"] += [None] * len(some)
                out["links"] += n[some].tolist()
            # the smallest node of each connected part of this block
            a, b, big = node.copy(), other.copy(), np.iinfo(np.int64).max
            while True:
                b2 = np.minimum(b, np.where(linked, a[:, None], big).min(0))
                a2 = np.minimum(a, np.where(linked, b2[None, :], big).min(1))
                if (a2 == a).all() and (b2 == b).all():
                    break
                a, b = a2, b2
            for ids, least in ((node, a), (other, b)):
                moved = np.flatnonzero(ids != least)
                out["a"] += ids[moved].tolist()
                out["b"] += least[moved].tolist()
                out["links"] += [0] * len(moved)
    return pd.DataFrame(out).astype({"a": "Int64", "b": "Int64", "links": "Int64"})


def _dealt(indexed: DataFrame) -> DataFrame:
    """Rows by ``label``, ``block`` and ``part``: the vectors of a block, and a slice of the vectors that ask for one of its lists."""
    sizes = stored(indexed.groupBy("label", "team").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")))
    block = lambda k: F.shiftleft(F.col("team").cast("long"), 32) + k
    home = stored(indexed.join(sizes, ["label", "team"]).withColumn("own", block(F.pmod(F.xxhash64("node"), "parts"))).drop("parts", "team"))
    asked = home.select("node", "label", "own", F.explode("probes").alias("team")).where(F.col("team") >= F.shiftright("own", 32)).join(sizes, ["label", "team"])
    asked = stored(asked.select("node", "label", "own", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), block)).alias("block")).where("own <= block"))
    slices = asked.groupBy("label", "block").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("slices"))
    cols = ["label", "block", "part", "node", "vec", "copies", "cell", "code", "off", "own"]
    held = home.withColumn("block", F.col("own")).join(slices, ["label", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    asks = asked.join(slices, ["label", "block"]).withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), "slices").cast("int")).join(home.drop("probes", "own"), ["node", "label"])
    return held.select(*cols, F.lit(False).alias("ask")).union(asks.select(*cols, F.lit(True).alias("ask")))


def _index(classes: DataFrame, cosine: float) -> tuple:
    """The shared index, and every vector with its list, code, the code's error and the teams of lists it asks."""
    spark = classes.sparkSession
    radius = math.sqrt(2 - 2 * cosine)
    per = stored(classes.groupBy("label").agg(F.count("*").alias("n")))
    n = per.agg(F.sum("n")).first()[0]
    sample = classes.select("vec").orderBy(F.xxhash64("node", "label")).limit(SAMPLE).toArrow().to_pandas()
    lists = min(LISTS, max(1, n // PER_LIST))
    shared = spark.sparkContext.broadcast(Index(_unit(sample["vec"]), lists))
    # as many teams of lists as a label has blocks; a team that is still too large is cut into several
    teams = F.least(F.ceil(F.col("n") / BLOCK), F.lit(lists)).cast("long").alias("teams")
    rows = joined_by_key(classes.select("label", "node", "vec", "copies"), per.select("label", "n", teams), "label", n).select("node", "label", "vec", "copies", "teams")
    return shared, stored(rows.mapInArrow(lambda it: _indexed(it, shared, radius), INDEXED))


def _links(classes: DataFrame, cosine: float) -> DataFrame:
    """Partners of each class (``a``, ``links``) and joining links (``a``, ``b``) among vectors of one dimension."""
    shared, indexed = _index(classes, cosine)
    return _dealt(indexed).groupBy("label", "block", "part").applyInPandas(lambda key, rows: _compare(key, rows, shared, cosine), "a long, b long, links long")


def vector_copies(vectors: DataFrame, cosine: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links`` (other vectors linked directly), ``component_id``, ``kept``.

    Vectors are compared when labels (of any type) are equal and not null and dimensions agree. Null, empty or zero vectors and vectors with
    null or non-finite components link with nothing, nor do rows without an id (component null, kept). Very long and very short
    vectors are compared by direction. Copies and repeated rows link with each other; a cosine of exactly ``cosine`` links. Rows that
    share an id count as one node of the components. Other columns are not carried, so their names cannot clash. An empty table gives no rows.
    """
    small_batches(vectors.sparkSession)
    rows = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[label].cast("string").alias("label"), vectors[embedding].cast("array<double>").alias("embedding"))
    usable = stored(rows.mapInArrow(_usable, "vec_id long, label string, vec binary"))
    good = usable.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull())
    classes = stored(good.groupBy("label", "vec").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")).withColumn("width", F.length("vec")))
    found = None
    for (width,) in classes.select("width").distinct().collect():
        part = _links(classes.where(F.col("width") == width), cosine)
        found = part if found is None else found.union(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "a long, b long, links long")
    found = stored(found)
    joined = components(found, "a", "b")
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    known = classes.join(links, "node", "left").join(joined, "node", "left")
    known = known.select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    alone = F.col("vec_id").isNull()
    out = usable.join(known, ["label", "vec"], "left")
    n = F.when(alone, F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("long")
    component = F.when(alone, F.lit(None)).otherwise(F.coalesce("component_id", "vec_id")).cast("long")
    out = out.select("vec_id", n.alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
