"""Near duplicates by HyperMinHash.

Each distinct word shingle is hashed once.  Its first bits choose one of 512
registers; a register keeps the smallest rest, compressed to its number of
leading zeros (6 bits) and the bits behind them (10 bits).  Empty registers
borrow from others in an order fixed by their number.  Bands of registers
put documents that may be alike into buckets.  A band has as many registers as
the threshold allows while two sets that just reach it share one with a
probability above 1 - ``MISS``; at 80 percent these are 73 bands of seven, and
two sets at a similarity of 0.05 share one with 6e-8, so that chance meetings
stay rare beside the documents however many there are.

Candidates are settled in two steps, without ever making all pairs of a bucket:

1. each bucket names a leader, and each member is compared with the leader that
   it meets in most of its buckets.  Most of a family is one component then;
2. buckets that still hold several components are gathered into groups (buckets
   that share members mostly share a group, so that a member goes to few), and
   members outside the largest component of a group meet all others of it inside
   a task: an index from shingle to members gives the size of every intersection
   at once, on the full sets.  A task hands on at most one link for each two
   components that it joins, never pairs.  Large groups are cut into blocks,
   and each block of members outside meets each block of the group in a task of
   bounded size.

A pair of step 1 is first estimated from the registers (with the expected share of
chance matches taken out) and then decided on the full shingle sets.

Documents with equal shingle sets form one class and take part once; classes
are formed by an aggregation that combines before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revcast.llm.common import forget, under_plain_names, written
from revcast.llm.components import components

BUCKET_BITS, MANTISSA_BITS = 9, 10
REGISTERS, REST_BITS = 1 << BUCKET_BITS, 64 - BUCKET_BITS
#: Two sets at the threshold share no band with this probability at most.
MISS = 1e-7
#: Pairs of at least this many shingles whose estimate lies this many standard
#: errors below the threshold are not looked at again.
ESTIMATED_FROM, SLACK = 100, 7.0
#: Members, and shingles, in a block of a group.
BLOCK_MEMBERS, BLOCK_SHINGLES = 2_000, 1 << 20

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


#: For each register, the order in which it borrows.
_BORROW = np.argsort(_mix(np.arange(REGISTERS * REGISTERS, dtype=_U) + _U(1)).reshape(REGISTERS, REGISTERS), axis=1)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; A-Z lower-cased.

    A text of fewer than ``width`` words is one shingle; one without words has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=_U)
    hashes = pd.util.hash_array(np.array(words, dtype=object), categorize=False).astype(_U)
    n = max(1, len(words) - width + 1)
    found = np.full(n, min(width, len(words)), dtype=_U)
    for k in range(min(width, len(words))):
        found = _mix(found * _U(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return np.unique(found)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The HyperMinHash registers of a non-empty set of sorted hashes."""
    bucket = (hashes >> _U(REST_BITS)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    rest = (hashes[first] & _U((1 << REST_BITS) - 1)) | _U(1)
    # In two halves, so that the position of the leading one is exact in floating point.
    high = (rest >> _U(28)).astype(np.float64)
    low = (rest & _U((1 << 28) - 1)).astype(np.float64)
    top = np.where(high > 0, np.frexp(high)[1] + 28, np.frexp(low)[1])  # bits from the leading one on
    zeros = (REST_BITS - top).astype(_U)
    # Drops the bucket's bits, the zeros and the one.
    behind = (rest << (zeros + _U(BUCKET_BITS + 1))) >> _U(64 - MANTISSA_BITS)
    value = np.zeros(REGISTERS, dtype=np.uint16)
    value[bucket[first]] = ((zeros << _U(MANTISSA_BITS)) | behind).astype(np.uint16)
    filled = np.zeros(REGISTERS, dtype=bool)
    filled[bucket[first]] = True
    empty = np.flatnonzero(~filled)
    k = 0
    while len(empty):
        source = _BORROW[empty, k]
        found = filled[source]
        value[empty[found]] = value[source[found]]
        empty = empty[~found]
        k += 1
    return value


def band_rows(percent: int) -> int:
    """Registers in a band: the most with which two sets at the threshold are missed rarely enough."""
    j = percent / 100
    return max((r for r in range(1, 65) if (1 - j**r) ** (REGISTERS // r) <= MISS), default=1)


def alone(percent: int) -> int:
    """Sets of up to this size reach the threshold only by being equal: the nearest other set has one shingle more."""
    n = 0
    while percent < 100 and 100 * (n + 1) < percent * (n + 2):
        n += 1
    return n


def band_keys(values: np.ndarray, width: int) -> np.ndarray:
    """64-bit keys of the bands of ``width`` registers, for rows of registers."""
    bands = REGISTERS // width
    rows = values[:, : bands * width].astype(_U).reshape(len(values), bands, width)
    key = np.arange(1, bands + 1, dtype=_U) * np.ones((len(values), 1), dtype=_U)
    for k in range(width):
        key = _mix(key * _U(0x9E3779B97F4A7C15) + rows[:, :, k])
    return key.astype(np.int64)


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The expected share of registers in which unrelated sets of these sizes agree."""
    steps = np.arange(1, 57)

    def zeros(size: np.ndarray) -> np.ndarray:
        load = np.asarray(size, dtype=float)[..., None] / REGISTERS
        return np.exp(-load * 2.0**-steps) - np.exp(-load * 2.0 ** (1 - steps))

    return (zeros(n) * zeros(m)).sum(axis=-1) / 2**MANTISSA_BITS


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from rows of registers, chance matches taken out."""
    by_chance = chance(n, m)
    return np.maximum(0.0, ((a == b).mean(axis=-1) - by_chance) / (1 - by_chance))


def worth_a_look(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs that the estimate does not rule out."""
    least = np.minimum(n, m)
    filled = REGISTERS * (1 - np.exp(-least / REGISTERS))
    error = np.sqrt(threshold * (1 - threshold) / filled)
    return (least < ESTIMATED_FROM) | (estimate(a, b, n, m) >= threshold - SLACK * error)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_shingles, set_key, registers`` of each row; key and registers are null for an empty set."""

    @F.pandas_udf("n_shingles long, set_key binary, registers binary")
    def sign(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            hashes = shingle_set(text, width)
            if len(hashes):
                key = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
                rows.append((len(hashes), key, registers(hashes).tobytes()))
            else:
                rows.append((0, None, None))
        return pd.DataFrame(rows, columns=["n_shingles", "set_key", "registers"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), sign("text").alias("__s"))
    return found.select("doc_id", "__s.*")


def _band_rows(classes: DataFrame, percent: int) -> DataFrame:
    """``key, rep, n``: one row for each band of each class."""
    width = band_rows(percent)
    bands = REGISTERS // width

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 2000):
                part = b.iloc[k : k + 2000]
                keys = band_keys(np.frombuffer(b"".join(part.registers), dtype=np.uint16).reshape(-1, REGISTERS), width)
                yield pd.DataFrame(
                    {
                        "key": keys.ravel(),
                        "rep": np.repeat(part.rep.to_numpy(), bands),
                        "n": np.repeat(part.n.to_numpy(), bands),
                    }
                )

    big = classes.filter(F.col("n") > (alone(percent) if percent < 100 else 1 << 60)).select("rep", "n", "registers")
    return big.mapInPandas(explode, "key long, rep long, n long")


def _stacked(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint16).reshape(-1, REGISTERS)


def _likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) that their registers do not rule out."""

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                likely = worth_a_look(_stacked(b.registers_a), _stacked(b.registers_b), b.n_a.to_numpy(), b.n_b.to_numpy(), percent / 100)
                yield b.loc[likely, ["a", "b"]]

    def side(x: str) -> DataFrame:
        return sets.select(F.col("rep").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "registers")))

    # Sort-merge joins: a member with very many candidates is split by adaptive execution.
    joined = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    return joined.mapInPandas(decide, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose full shingle sets are alike enough."""

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            alike = []
            for one, other in zip(b.set_a, b.set_b, strict=True):
                one, other = np.frombuffer(one, dtype=_U), np.frombuffer(other, dtype=_U)
                both = len(np.intersect1d(one, other, assume_unique=True))
                alike.append(100 * both >= percent * (len(one) + len(other) - both))
            yield b.loc[np.array(alike, dtype=bool), ["a", "b"]]

    def side(x: str) -> DataFrame:
        return sets.select(F.col("rep").alias(x), F.col("set").alias(f"set_{x}"))

    joined = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    return joined.mapInPandas(decide, "a long, b long")


def _with_sets(reps: DataFrame, ids: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """``reps`` with the shingle ``set`` (sorted hashes as bytes) of their text; ``ids`` are theirs alone."""

    @F.pandas_udf("binary")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, width).tobytes() for t in texts])

    # While the ids are few they are broadcast, and no other text is shuffled; else both joins use one shuffle of the texts.
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(ids, "rep", "left_semi")
    return reps.join(texts, "rep").select(*reps.columns, hashed("text").alias("set"))


def settle(reps: np.ndarray, component: np.ndarray, sets: list[np.ndarray], asks: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join the components of members that are alike enough, where one of them ``asks``.

    One for each two components that are joined.  ``component`` is changed.
    """
    n = np.array([len(s) for s in sets])
    ends = np.cumsum(n)
    known, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(shingle, kind="stable")
    owner = np.repeat(np.arange(len(sets)), n)[order]
    starts = np.searchsorted(shingle[order], np.arange(len(known) + 1))
    links = []
    for i in np.flatnonzero(asks):
        if (component == component[i]).all():
            break
        own = shingle[ends[i] - n[i] : ends[i]]
        first, size = starts[own], starts[own + 1] - starts[own]
        places = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
        both = np.bincount(owner[places], minlength=len(sets))
        near = np.flatnonzero((100 * both >= percent * (n[i] + n - both)) & (component != component[i]))
        joined, at = np.unique(component[near], return_index=True)
        links += [(int(reps[i]), int(reps[j])) for j in near[at]]
        component[np.isin(component, joined)] = component[i]
    return links


def _groups(named: DataFrame) -> DataFrame:
    """``label, rep, component, n``: members of the buckets that hold several components, by group.

    Two members of a bucket have a group in common.  A bucket's group is the least id that
    is two meetings away, so the buckets of a family mostly agree on it.
    """
    several = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("rep").alias("least"))
    several = several.filter("low <> high").select("key", "least")
    mixed = written(named.join(several, "key"), "mixed")
    nearest = mixed.groupBy("rep").agg(F.min("least").alias("met"))
    label = mixed.select("key", "rep").join(nearest, "rep").groupBy("key").agg(F.min("met").alias("label"))
    groups = written(mixed.join(label, "key").select("label", "rep", "component", "n").distinct(), "groups")
    forget(mixed)
    return groups


def _settled(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (``a``, ``b``) between the components of each group."""
    sizes = groups.groupBy("label", "component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"))
    facts = sizes.groupBy("label").agg(
        F.max_by("component", F.struct("size", "component")).alias("home"), F.sum("size").alias("size"), F.sum("shingles").alias("shingles")
    )
    parts = F.greatest(F.ceil(F.col("size") / BLOCK_MEMBERS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    own = written(groups.join(facts.withColumn("parts", parts).drop("size", "shingles"), "label"), "group-members")
    small, large = own.filter("parts = 1"), own.filter("parts > 1")
    # Small groups share tasks; of a large one each block of members outside meets each block.
    bins = 1 + (small.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // BLOCK_SHINGLES)
    columns = ["label", "rep", "component"]
    outside = F.col("component") != F.col("home")
    in_bins = small.select(*columns, outside.alias("asks"), F.pmod(F.xxhash64("label"), F.lit(bins)).alias("bin"))
    place = F.pmod(F.xxhash64("rep"), F.col("parts"))
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    asking = large.filter(outside).select(*columns, F.lit(True).alias("asks"), place.alias("one"), each.alias("other"))
    asked = large.select(*columns, F.lit(False).alias("asks"), place.alias("other"), "parts").select(*columns, "asks", each.alias("one"), "other")
    asked = asked.join(asking.select("label", "one").distinct(), ["label", "one"], "left_semi")
    # Above all numbers of bins, so that no two tasks are one.
    blocks = asking.unionByName(asked.select(*columns, "asks", "one", "other")).withColumn("bin", F.xxhash64("label", "one", "other").bitwiseOR(F.lit(1 << 62))).drop("one", "other")
    rows = in_bins.unionByName(blocks).join(sets.select("rep", "set").hint("merge"), "rep")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        links = []
        for _, g in rows.groupby("label", sort=False):
            # A member that asks and is asked in the same task takes part once, with each of its texts.
            g = g.sort_values("asks", ascending=False).drop_duplicates(["rep", "set"])
            sets = [np.frombuffer(x, dtype=_U) for x in g["set"]]
            links += settle(g.rep.to_numpy(), g.component.to_numpy().copy(), sets, g.asks.to_numpy(), percent)
        return pd.DataFrame(links, columns=["a", "b"])

    return rows.groupBy("bin").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs`` (``doc_id``, ``text``).

    Documents are linked when 100 * intersection >= percent * union of their
    sets of ``width``-word shingles; a component is named by its smallest id and
    keeps that document.  A null or empty text, or one of white space, has an
    empty set and is linked with nothing.  Rows that share an id are one
    document with the links of all of them.  A row without id links with
    nothing: it has no component and is kept.  An empty table gives no rows;
    other columns are not read.  Two sets at the threshold miss all bands with a
    probability of ``MISS`` at most.
    """
    signed = written(signatures(docs, width), "signatures")
    classes = written(
        signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("n"), F.any_value("registers").alias("registers")),
        "classes",
    )
    # Registers are most of the disk here: each step leaves only what later ones read.
    marks = written(signed.select("doc_id", "n_shingles", "set_key"), "marks")
    forget(signed)
    bands = _band_rows(classes, percent)
    shared = written(bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("key"), "shared-bands")
    members = written(bands.join(shared, "key"), "members")
    forget(shared)
    met = written(members.select("rep").distinct(), "met")
    known = written(classes.select("rep", "n", "registers").join(met, "rep"), "met-classes")
    names = written(classes.select("set_key", "rep"), "class-names")
    forget(classes)
    sets = written(_with_sets(known, met, docs, width), "sets")
    forget(known, met)

    # 1. A leader for each bucket, by the same order in all of them.
    order = F.xxhash64("rep")
    leaders = members.groupBy("key").agg(F.min_by("rep", order).alias("a"), F.min_by("n", order).alias("leader_n"))
    leaders = written(leaders, "leaders")
    led = members.join(leaders.hint("merge"), "key").filter("rep <> a")
    led = led.filter(f"100 * least(n, leader_n) >= {percent} * greatest(n, leader_n)")
    together = led.groupBy(F.col("rep").alias("b"), "a").agg(F.count(F.lit(1)).alias("times"))
    pairs = together.groupBy("b").agg(F.max_by("a", F.struct("times", "a")).alias("a")).select("a", "b")
    links = written(_confirmed(_likely(pairs, sets, percent), sets, percent), "led")
    forget(leaders)

    # 2. What is still apart in a bucket, by groups.
    labels = components(links)
    named = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    named = written(named.withColumn("component", F.coalesce("component", "rep")), "named")
    forget(members)
    groups = _groups(named)
    forget(named)
    if not groups.isEmpty():
        labels = components(links.unionByName(written(_settled(groups, sets, percent), "settled")))
    named = names.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    by_set = written(named.select("set_key", F.coalesce("component", "rep").alias("component_id")), "component-of-set")
    forget(sets, links, groups, names)
    return (
        marks.join(by_set.hint("merge"), "set_key", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row for each component, the one with the smallest id, and all its columns.

    Rows without an id stay.  Where rows share a kept id, one of them stays.  A
    null or empty text is like no other, so its row stays; an empty table gives no rows.
    """
    return under_plain_names(docs, lambda own: _keep_one(own, width, percent))


def _keep_one(docs: DataFrame, width: int, percent: int) -> DataFrame:
    verdicts = near_duplicates(docs, width, percent)
    ids = verdicts.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(F.first("kept").alias("__kept"), F.count(F.lit(1)).alias("__n"))
    # Only the ids that lose rows, in a file of known size: while they are few Spark broadcasts them and shuffles no text.
    ids = written(ids.filter("NOT __kept OR __n > 1"), "verdicts")
    own = docs.withColumn("__own", F.col("doc_id").cast("long"))
    rest = own.join(ids, F.col("__own") == F.col("__id"), "left_anti")
    repeated = ids.filter("__kept AND __n > 1").select("__id")
    if not repeated.isEmpty():
        once = own.join(repeated, F.col("__own") == F.col("__id"), "left_semi").dropDuplicates(["__own"])
        rest = rest.unionByName(once)
    return rest.drop("__own")
