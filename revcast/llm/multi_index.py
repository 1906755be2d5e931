"""Nearest neighbours by multi-index hashing.

A vector becomes a code of 128 bits: the signs of its coordinates after learned
rotations (principal axes of a sample, turned until the signs lie closest to the
coordinates).  A code is cut into eight substrings of sixteen bits, and each
substring has an index of its own, addressed by its value.  Two codes that
differ in at most ``r`` bits have, by the pigeonhole principle, a substring ``j``
that differs in at most ``r_j`` bits wherever the ``r_j + 1`` add up to ``r + 1``;
so probing each index with every value within ``r_j`` bits of the query's finds
every code within the radius.  What the probes retrieve is checked on the whole
code and then ranked by the inner product of the original vectors.

Largest inner products are smallest angles once each vector has a further
coordinate that brings all of them to the same length (a query has 0 there).

The rotations and the radius come from a sample of at most ``SAMPLE_VALUES``
numbers: the radius holds ``CAUGHT`` of the sample's own nearest neighbours.
In the whole table neighbours are nearer than in a sample of it, so that it holds
more of them there.

All vectors are indexed.  They are dealt over blocks, the queries over blocks of
theirs, and each pair of blocks is one task with bounded memory, which hands on
its best ``k`` of each query.  A query that has fewer than ``k`` within the radius
widens its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revcast.llm.common import written
from revcast.llm.vectors import finite_vectors

BITS, SUBSTRING = 128, 16
TABLES = BITS // SUBSTRING
#: The sample that rotations and radius are learned from holds at most so many numbers.
SAMPLE_VALUES = 1 << 20
CALIBRATION_QUERIES, CAUGHT = 512, 0.98
TURNS = 25
#: Rows of the index, and queries, in a task.
BLOCK_ROWS, QUERY_ROWS = 65_536, 1_024
#: Bits by which a query widens its radius until it has found enough.
WIDER = 8

_VALUES = np.arange(1 << SUBSTRING, dtype=np.int64)
_WEIGHTS = np.bitwise_count(_VALUES)
#: All substring values by the number of their bits, and how many have at most so many.
_MASKS = np.argsort(_WEIGHTS, kind="stable")
_WITHIN = np.cumsum(np.bincount(_WEIGHTS, minlength=SUBSTRING + 1))


@dataclass
class Index:
    """Codes and vectors of all rows in a table, and what was learned from the sample."""

    rows: DataFrame
    n: int
    projection: np.ndarray
    longest: float
    radius: int


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """The vectors with a coordinate that brings each to the length ``longest``."""
    rest = np.maximum(0.0, longest * longest - (vectors * vectors).sum(axis=1))
    return np.column_stack([vectors, np.sqrt(rest)])


def asked(vectors: np.ndarray) -> np.ndarray:
    """Queries among lifted vectors."""
    return np.column_stack([vectors, np.zeros(len(vectors))])


def learn(sample: np.ndarray, bits: int = BITS, seed: int = 7) -> np.ndarray:
    """A projection whose signs are the code: as many rotations of the principal axes as
    the bits need, each turned so that the coordinates lie close to their signs."""
    rng = np.random.default_rng(seed)
    axes = np.linalg.eigh(sample.T @ sample)[1][:, ::-1]
    parts, left = [], bits
    while left:
        width = min(left, sample.shape[1])
        reduced = sample @ axes[:, :width]
        rotation = np.linalg.qr(rng.normal(size=(width, width)))[0]
        for _ in range(TURNS):
            signs = np.where(reduced @ rotation > 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(reduced.T @ signs)
            rotation = u @ v
        parts.append(axes[:, :width] @ rotation)
        left -= width
    return np.concatenate(parts, axis=1)


def encode(points: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """One row of ``BITS // 8`` bytes for each point."""
    return np.packbits(points @ projection > 0, axis=1)


def calibrated(sample: np.ndarray, longest: float, projection: np.ndarray, k: int, caught: float = CAUGHT) -> int:
    """The radius that holds the share ``caught`` of the sample's nearest neighbours."""
    n = len(sample)
    if n <= k + 1:
        return BITS
    codes = encode(lifted(sample, longest), projection).view(np.uint64)
    queries = sample[:CALIBRATION_QUERIES]
    own = encode(asked(queries), projection).view(np.uint64)
    scores = queries @ sample.T
    scores[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    apart = np.bitwise_count(own[:, None, :] ^ codes[near]).sum(axis=2)
    return int(np.quantile(apart, caught, method="higher"))


def radii(radius: int) -> list[int]:
    """A radius for each substring; they hold every code within ``radius``.  -1: no probe."""
    each, more = divmod(radius + 1, TABLES)
    return [min(SUBSTRING, each - 1 + (j < more)) for j in range(TABLES)]


class Block:
    """The substring indexes over one block of codes."""

    def __init__(self, codes: np.ndarray):
        self.words = codes.view(np.uint64)
        self.tables = []
        for keys in codes.view(np.uint16).T:
            order = np.argsort(keys, kind="stable")
            self.tables.append((order, np.searchsorted(keys[order], np.arange((1 << SUBSTRING) + 1))))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """The places of all codes that differ from ``code`` in at most ``radius`` bits."""
        seen = np.zeros(len(self.words), dtype=bool)
        for key, own, (order, starts) in zip(code.view(np.uint16), radii(radius), self.tables, strict=True):
            if own >= 0:
                keys = _MASKS[: _WITHIN[own]] ^ int(key)
                first, size = starts[keys], starts[keys + 1] - starts[keys]
                hit = size > 0
                first, size = first[hit], size[hit]
                if len(size):
                    places = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
                    seen[order[places]] = True
        found = np.flatnonzero(seen)
        return found[np.bitwise_count(self.words[found] ^ code.view(np.uint64)).sum(axis=1) <= radius]


def _stacked(column: pd.Series, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=kind).reshape(len(column), -1)


def search_block(block: pd.DataFrame, queries: pd.DataFrame, radius: int, k: int) -> pd.DataFrame:
    """``query_id, vec_id, score``: for each query the best ``k`` of the block, or all if it has fewer."""
    found = []
    if len(block) and len(queries):
        ids, vectors = block.vec_id.to_numpy(), _stacked(block.vector, np.float64)
        index = Block(_stacked(block.code, np.uint8))
        of = _stacked(queries.vector, np.float64)
        for query_id, vector, code in zip(queries.query_id, of, _stacked(queries.code, np.uint8), strict=True):
            own, reach = ids == query_id, radius
            while True:
                near = index.within(code, reach)
                near = near[~own[near]]
                if len(near) >= k or reach >= BITS:
                    break
                reach = min(BITS, reach + WIDER)
            # Row by row, so that equal vectors get equal scores wherever they stand.
            scores = (vectors[near] * vector).sum(axis=1)
            if len(near) > k:
                best = scores >= np.partition(scores, len(near) - k)[len(near) - k]
                near, scores = near[best], scores[best]
            order = np.lexsort((ids[near], -scores))[:k]
            found.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[near][order], "score": scores[order]}))
    return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def build(rows: DataFrame, k: int = 20, id_column: str = "vec_id", vector: str = "embedding") -> Index:
    """Learn from a sample of the rows, then index every row that takes part."""
    vectors = finite_vectors(rows, id_column, vector).filter("vec_id IS NOT NULL").filter(F.exists("vector", lambda x: x != 0))
    vectors = written(vectors.groupBy("vec_id").agg(F.min("vector").alias("vector")), "vectors")
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    facts = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(squares).alias("s"), F.max(F.size("vector")).alias("d")).first()
    if not facts["n"]:
        return Index(vectors.selectExpr("vec_id", "binary('') AS vector", "binary('') AS code"), 0, np.zeros((1, BITS)), 0.0, BITS)
    longest = float(np.sqrt(facts["s"]))
    # By the hash of the id, so that the sample does not depend on the partitions.
    drawn = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, SAMPLE_VALUES // facts["d"]))
    sample = np.array([r["vector"] for r in drawn.select("vector").collect()])
    projection = learn(lifted(sample, longest))

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                points = np.stack(b.vector.to_list()).astype(np.float64)
                codes = encode(lifted(points, longest), projection)
                yield pd.DataFrame({"vec_id": b.vec_id, "vector": [p.tobytes() for p in points], "code": [c.tobytes() for c in codes]})

    index = written(vectors.mapInPandas(coded, "vec_id long, vector binary, code binary"), "codes")
    return Index(index, facts["n"], projection, longest, calibrated(sample, longest, projection, k))


def search(index: Index, queries: DataFrame, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of ``index`` nearest to each of
    ``queries`` (rows ``vec_id, vector, code`` like the index's own), itself left out."""
    projection = index.projection

    def recoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                codes = encode(asked(_stacked(b.vector, np.float64)), projection)
                yield pd.DataFrame({"query_id": b.vec_id, "vector": b.vector, "code": [c.tobytes() for c in codes]})

    asking = written(queries.select("vec_id", "vector").mapInPandas(recoded, "query_id long, vector binary, code binary"), "queries")
    blocks = -(-max(1, index.n) // BLOCK_ROWS)
    query_blocks = -(-max(1, asking.count()) // QUERY_ROWS)

    def dealt(rows: DataFrame, own: str, id_column: str, n: int, other: str, copies: int) -> DataFrame:
        """Rows in their own block, once for each block of the other side."""
        rows = rows.withColumn(own, F.pmod(F.xxhash64(id_column), F.lit(n)).cast("int"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

    def run(block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        return search_block(block, queries, radius, k)

    radius = index.radius
    left = dealt(index.rows, "block", "vec_id", blocks, "query_block", query_blocks).groupBy("block", "query_block")
    right = dealt(asking, "query_block", "query_id", query_blocks, "block", blocks).groupBy("block", "query_block")
    found = left.cogroup(right).applyInPandas(run, "query_id long, vec_id long, score double")
    # Spark keeps the first k of each task before it brings a query's rows together.
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """The ``k`` nearest rows of each row whose ``vec_id`` is divisible by ``every``.

    ``rows`` has ``vec_id`` and ``embedding``; other columns are not read.  Nearest
    means the largest inner product of the original vectors in double precision,
    ties to the smaller id.  Rows take no part, neither as query nor as candidate,
    if their id is null, or their vector is null, empty, zero, of another length
    than most, or holds null or non-finite entries.  An id names one vector: of
    rows that share it the one whose vector sorts first stands for them.  A query
    with fewer than ``k`` other rows gets all of them; an empty table gives none.
    """
    index = build(rows, k)
    return search(index, index.rows.filter(F.col("vec_id") % every == 0), k)
