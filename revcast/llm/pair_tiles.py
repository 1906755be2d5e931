"""Phrase collocations by direct-address tiling.

Words are known to the tasks by 64-bit symbols that name the language too; a job
checks that no two words share one.  In each task a chunk of a language's words
gets ids by falling frequency, so that frequent pairs lie together: the square of
pairs is cut into tiles, and a tile that holds many occurrences is counted
directly, by ``bincount`` into one cell for each pair, the others as coordinates
that are sorted.  The next level does the same one step up: pairs that are frequent
enough get ids by falling frequency, and pairs of (pair, word) and (pair, pair)
are the phrases of three and four words.

Three passes read the texts, each followed by one sum over what the chunks
counted: words, pairs of frequent words, and longer phrases all of whose pairs
are frequent.  No phrase is more frequent than a part of it, so the passes lose
none.  What is frequent reaches the tasks as a bitmap of symbols of bounded size;
a symbol that is in it by chance only costs time, as the sums decide.  Scores,
containment and ranks are joins and sums over the frequent phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revcast.llm.common import written

#: Bytes of text in a chunk.  A longer text is a chunk of its own.
CHUNK_BYTES = 8_000_000
#: Side of a tile, and tiles of the square's corner that may be counted directly.
TILE, CORNER = 1 << 10, 4
#: A tile is counted directly if it holds one occurrence for so many cells.
SPARSE = 16
#: Bits of the bitmap for each symbol in it, and at most.
BITS_EACH, MOST_BITS = 32, 28
#: Parts of a language's phrases that are ranked before they meet.
PARTS = 64

#: A mark between pieces; it is a separator itself, so no word holds it.
GAP = b"."
_PIECES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b".......... ")

_U = np.uint64
#: The words of a phrase; 0 stands for none.
WORDS = ["w1", "w2", "w3", "w4"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def pieces_of(texts: list[str]) -> list[bytes]:
    """The words of the texts, with ``GAP`` wherever a piece or a text ends."""
    joined = "\n".join(texts).encode("utf-8", "surrogatepass").lower()
    return joined.translate(_PIECES).replace(b".", b" . ").split()


def symbols_of(words: np.ndarray, lang: str, seed: int) -> np.ndarray:
    """Positive symbols of distinct words (bytes); the gap's is 0."""
    name = _mix(pd.util.hash_array(np.array([lang.encode("utf-8", "surrogatepass")], dtype=object), categorize=False).astype(_U) + _U(seed))
    own = _mix(pd.util.hash_array(words, categorize=False).astype(_U) * _U(0x9E3779B97F4A7C15) + name)
    return np.where(words == GAP, 0, np.maximum(1, (own >> _U(1)).astype(np.int64)))


def pair_symbols(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (_mix(left.astype(_U) * _U(0x9E3779B97F4A7C15) + right.astype(_U)) >> _U(1)).astype(np.int64)


def by_frequency(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``n`` codes its rank by falling frequency, and the code of each rank."""
    order = np.argsort(-np.bincount(codes, minlength=n), kind="stable")
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    return rank, order


def tile_counts(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of two rows of ranks, and how often each occurs."""
    corner = (left < CORNER * TILE) & (right < CORNER * TILE)
    a, b = left[corner], right[corner]
    tile = a // TILE * CORNER + b // TILE
    held = np.bincount(tile, minlength=CORNER * CORNER)
    dense = np.flatnonzero(held >= TILE * TILE // SPARSE)
    found = []
    for t in dense:
        own = tile == t
        cells = np.bincount(a[own] % TILE * TILE + b[own] % TILE, minlength=TILE * TILE)
        at = np.flatnonzero(cells)
        found.append((t // CORNER * TILE + at // TILE, t % CORNER * TILE + at % TILE, cells[at]))
    rest = ~corner
    rest[np.flatnonzero(corner)[~np.isin(tile, dense)]] = True
    code, n = np.unique(left[rest] << 32 | right[rest], return_counts=True)
    found.append((code >> 32, code & 0xFFFFFFFF, n))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def holds(bitmap: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Which symbols may be in the bitmap; 0 is not."""
    at = symbols & (len(bitmap) * 8 - 1)
    return (symbols > 0) & ((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


class Chunk:
    """Some texts of a language: its distinct words, their symbols and the row of words as ranks."""

    def __init__(self, texts: list[str], lang: str, seed: int):
        codes, words = pd.factorize(np.array(pieces_of(texts), dtype=object))
        self.words = words
        self.symbols = symbols_of(words, lang, seed) if len(words) else np.zeros(0, dtype=np.int64)
        self.codes = codes

    def word_counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, symbols and counts; the gap counts all words together."""
        n = np.bincount(self.codes, minlength=len(self.words))
        real = self.symbols > 0
        total = n[real].sum()
        return np.append(self.words[real], GAP), np.append(self.symbols[real], 0), np.append(n[real], total)

    def ranked(self, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols by rank, the words as ranks, and which of them may be frequent."""
        rank, order = by_frequency(self.codes, len(self.words))
        may = holds(frequent, self.symbols)
        return self.symbols[order], rank[self.codes], may[self.codes]

    def pairs(self, frequent: np.ndarray) -> tuple[np.ndarray, ...]:
        """``w1, w2, n`` of neighbours that may both be frequent."""
        symbols, row, may = self.ranked(frequent)
        both = may[:-1] & may[1:]
        a, b, n = tile_counts(row[:-1][both], row[1:][both])
        return symbols[a], symbols[b], n

    def longer(self, frequent: np.ndarray, frequent_pairs: np.ndarray) -> tuple[np.ndarray, ...]:
        """``w1, w2, w3, w4, n`` of phrases of three (``w4`` 0) and four words whose pairs may all be frequent."""
        symbols, row, may = self.ranked(frequent)
        at = np.flatnonzero(may[:-1] & may[1:])
        at = at[holds(frequent_pairs, pair_symbols(symbols[row[at]], symbols[row[at + 1]]))]
        # Pairs become the units of the next level, with ids by falling frequency.
        known, code = np.unique(row[at] << 32 | row[at + 1], return_inverse=True)
        rank, order = by_frequency(code, len(known))
        first, second = symbols[known[order] >> 32], symbols[known[order] & 0xFFFFFFFF]
        unit = np.full(len(row) + 2, -1, dtype=np.int64)
        unit[at] = rank[code]
        three = at[unit[at + 1] >= 0]
        four = three[unit[three + 2] >= 0]
        a, b, n = tile_counts(unit[three], row[three + 2])
        c, d, m = tile_counts(unit[four], unit[four + 2])
        return (
            np.concatenate([first[a], first[c]]),
            np.concatenate([second[a], second[c]]),
            np.concatenate([symbols[b], first[d]]),
            np.concatenate([np.zeros(len(a), dtype=np.int64), second[d]]),
            np.concatenate([n, m]),
        )


def _chunks(batches: Iterator[pd.DataFrame], seed: int) -> Iterator[tuple[str, Chunk]]:
    """The texts of a task by language, in chunks."""
    waiting: dict[str, list[str]] = {}
    size: dict[str, int] = {}
    for b in batches:
        for lang, text in zip(b.lang, b.text, strict=True):
            waiting.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text) + 1
            if size[lang] >= CHUNK_BYTES:
                yield lang, Chunk(waiting.pop(lang), lang, seed)
                size.pop(lang)
        # However many languages there are, little waits.
        while sum(size.values()) >= 2 * CHUNK_BYTES:
            lang = max(size, key=size.get)
            yield lang, Chunk(waiting.pop(lang), lang, seed)
            size.pop(lang)
    for lang, texts in waiting.items():
        yield lang, Chunk(texts, lang, seed)


def word_table(docs: DataFrame, seed: int) -> DataFrame:
    """``lang, word, symbol, f`` of every word; the word ``GAP`` holds a language's number of words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lang, chunk in _chunks(batches, seed):
            words, symbols, n = chunk.word_counts()
            yield pd.DataFrame({"lang": lang, "word": words, "symbol": symbols, "n": n})

    counted = docs.mapInPandas(run, "lang string, word binary, symbol long, n long")
    return counted.groupBy("lang", "word", "symbol").agg(F.sum("n").alias("f"))


def bitmap(symbols: DataFrame) -> np.ndarray:
    """A bitmap of the column ``symbol``, of at most ``2 ** MOST_BITS`` bits (32 MB) however many there are."""
    n = symbols.count()
    bits = min(MOST_BITS, max(10, int(n * BITS_EACH - 1).bit_length()))
    place = F.col("symbol").bitwiseAND(F.lit((1 << bits) - 1))
    cell = F.shiftright(place, 6).cast("int").alias("cell")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    rows = symbols.groupBy(cell).agg(F.bit_or(mask).alias("mask")).toPandas()
    cells = np.zeros(1 << (bits - 6), dtype="<i8")
    cells[rows["cell"].to_numpy()] = rows["mask"].to_numpy()
    return cells.view(np.uint8)


def _summed(docs: DataFrame, seed: int, count, columns: list[str], least: int) -> DataFrame:
    """What ``count`` makes of each chunk, summed up; phrases with at least ``least`` stay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, chunk in _chunks(batches, seed):
            yield pd.DataFrame(dict(zip([*columns, "n"], count(chunk), strict=True)))

    rows = docs.mapInPandas(run, ", ".join(f"{c} long" for c in [*columns, "n"]))
    return rows.groupBy(*columns).agg(F.sum("n").alias("f")).filter(F.col("f") >= least)


def phrases(docs: DataFrame, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """Words (``lang, word, symbol, f``) and phrases of two to four words (``w1`` to ``w4``,
    symbols or 0, and ``f``) that occur at least ``least`` times in a language, among the
    words also the row ``GAP`` of each language."""
    spark = docs.sparkSession
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    seed = 1
    while True:
        words = written(word_table(own, seed), "words")
        shared = words.filter("symbol > 0").groupBy("symbol").count().filter("count > 1")
        if shared.isEmpty():
            break
        seed += 1
    words = words.filter((F.col("f") >= least) | (F.col("symbol") == 0))
    frequent = spark.sparkContext.broadcast(bitmap(words.filter("symbol > 0").select("symbol")))
    pairs = written(_summed(own, seed, lambda chunk: chunk.pairs(frequent.value), WORDS[:2], least), "frequent-pairs")

    @F.pandas_udf("long")
    def joint(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series(pair_symbols(left.to_numpy(), right.to_numpy()))

    known = spark.sparkContext.broadcast(bitmap(pairs.select(joint("w1", "w2").alias("symbol"))))
    longer = written(_summed(own, seed, lambda chunk: chunk.longer(frequent.value, known.value), WORDS, least), "longer-phrases")
    zero = F.lit(0).cast("long")
    return words, pairs.select("w1", "w2", zero.alias("w3"), zero.alias("w4"), "f").unionByName(longer)


def _part(*symbols: Column | str) -> Column:
    """A part of a phrase as three symbols, padded by 0."""
    padded = [F.col(s) if isinstance(s, str) else s for s in symbols] + [F.lit(0).cast("long")] * (3 - len(symbols))
    return F.struct(*(p.alias(f"p{k + 1}") for k, p in enumerate(padded)))


def _slots(length: Column) -> Column:
    """The parts of a phrase by slot: 1 to 4 its words, 5 and 6 its first two and three
    words, 7 and 8 its last two and three, where these are not all."""
    w1, w2, w3, w4 = WORDS
    three, four = length >= 3, length == 4
    listed = [
        (F.lit(True), 1, _part(w1)),
        (F.lit(True), 2, _part(w2)),
        (three, 3, _part(w3)),
        (four, 4, _part(w4)),
        (three, 5, _part(w1, w2)),
        (four, 6, _part(w1, w2, w3)),
        (three, 7, F.when(four, _part(w3, w4)).otherwise(_part(w2, w3))),
        (four, 8, _part(w2, w3, w4)),
    ]
    slots = F.array(*(F.when(there, F.struct(F.lit(k).alias("slot"), part.alias("p"))) for there, k, part in listed))
    return F.filter(slots, lambda s: s.isNotNull())


def _inner(length: Column) -> Column:
    """The phrases of two words or more inside a longer one."""
    w1, w2, w3, w4 = WORDS
    three = [_part(w1, w2), _part(w2, w3)]
    return F.when(length == 4, F.array(*three, _part(w3, w4), _part(w1, w2, w3), _part(w2, w3, w4))).when(length == 3, F.array(*three))


def scored(words: DataFrame, found: DataFrame, inside_percent: int = 80) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of the phrases that no longer one covers."""
    length = F.lit(2) + (F.col("w3") > 0).cast("int") + (F.col("w4") > 0).cast("int")
    found = found.withColumn("length", length)
    longer = found.filter("length > 2").select(F.explode(_inner(F.col("length"))).alias("p"), "f")
    around = longer.groupBy("p.p1", "p.p2", "p.p3").agg(F.max("f").alias("most"))
    # Phrases of four words are inside none.
    key = (F.col("w1") == F.col("p1")) & (F.col("w2") == F.col("p2")) & (F.col("w3") == F.col("p3")) & (F.col("w4") == 0)
    open_ = found.join(around, key, "left").filter(F.coalesce(F.lit(100) * F.col("most") < F.lit(inside_percent) * F.col("f"), F.lit(True)))
    open_ = open_.select(*WORDS, "length", F.col("f").alias("a"))

    none = F.lit(0).cast("long")
    singles = words.filter("symbol > 0").select(F.col("symbol").alias("p1"), none.alias("p2"), none.alias("p3"), "f", "lang", "word")
    several = found.filter("w4 = 0").select(
        F.col("w1").alias("p1"), F.col("w2").alias("p2"), F.col("w3").alias("p3"), "f", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("binary").alias("word")
    )
    asked = open_.select(*WORDS, "length", "a", F.explode(_slots(F.col("length"))).alias("s")).select(*WORDS, "length", "a", "s.slot", "s.p.*")
    answers = asked.join(singles.unionByName(several), ["p1", "p2", "p3"])

    def at(slot: int, column: str) -> Column:
        return F.max(F.when(F.col("slot") == slot, F.col(column)))

    whole = answers.groupBy(*WORDS, "length", "a").agg(
        F.max("lang").alias("lang"),
        *(at(k, "f").alias(f"f{k}") for k in range(1, 9)),
        *(at(k, "word").alias(f"t{k}") for k in range(1, 5)),
    )

    def cut(k: int, left: int, right: int) -> Column:
        l, r = F.col(f"f{left}"), F.col(f"f{right}")
        # Whole numbers of 38 digits: the product may pass 64 bits.
        score = F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * F.col("a").cast("decimal(20,0)"), (l + r).cast("decimal(20,0)"))
        return F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r"))

    least = (
        F.when(F.col("length") == 2, cut(1, 1, 2))
        .when(F.col("length") == 3, F.least(cut(1, 1, 7), cut(2, 5, 3)))
        .otherwise(F.least(cut(1, 1, 8), cut(2, 5, 7), cut(3, 6, 4)))
    )
    phrase = F.concat_ws(" ", *(F.col(f"t{k}").cast("string") for k in range(1, 5)))
    return whole.select("lang", phrase.alias("phrase"), "a", least.alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language.

    A phrase is two to four words of one piece of a text of ``docs`` (``text``, ``lang``;
    other columns are not read) that occurs at least ``least`` times in its language.
    A null language is ``und``, as are rows that say so; a null or empty text has no
    words, every other row counts, also repeated ones.  Ties in score go to the more
    frequent phrase, then to the one whose UTF-8 sorts first.  A language without such
    a phrase, and an empty table, give no rows.
    """
    words, found = phrases(docs, least)
    table = scored(words, found)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of each part first, so that a language with most of the phrases is not one task.
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    best = table.withColumn("__k", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(F.col("__k") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    sizes = words.filter("symbol = 0").select("lang", F.col("f").alias("n"))
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
