"""Quality rules: an isolation forest on rule statistics.

``rule_stats`` counts what common text rules look at (words, symbols, repeated
lines, repeated three-word windows, capitals, ...).  ``fit`` grows an isolation
forest over rates made from these counts and calibrates the score at which a
document counts as anomalous; ``verdicts`` and ``keep_good`` apply it to every
document.

The forest isolates with random splits: a node picks a rate and a cut at random
inside its box, and a document's path ends early where few of the trees' rows
lie.  Trees count documents labelled good; their root box spans all labelled
rows, so that regions where only bad documents lie are cut off near the root.

Every labelled document takes part: splits depend on the box alone, so tasks send
all good rows down all trees and the counts of their leaves add up.  Instead of
drawing rows for each tree, all of them weigh together what ``TREE_ROWS`` do.  The
threshold is an exact order statistic of the scores of all good rows.  Only the box,
leaf counts and thresholds reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revcast.llm.common import forget, written

#: Trees, and the rows that all good ones weigh in each.
TREES, TREE_ROWS = 120, 256
#: Most rows that ``labelled_sample`` hands out.
MAX_LABELLED = 20_000
#: Share of documents labelled good that calibration may reject.
MAX_GOOD_LOSS = 0.0005

SYMBOLS = "#*$%&|<>"
_GAPS = " \t\n\x0b\x0c\r"
_CAPITALS = bytes(range(65, 91))
_DIGITS = b"0123456789"
#: ASCII words without a letter or digit.
_BARE = re.compile(rb"(?<![^\s])[!-/:-@\[-`{-~]+(?![^\s])")

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_digits", "n_marks", "n_bare"]
RATES = ["word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "capital_rate", "digit_rate", "mark_rate", "bare_rate", "line_words", "size"]


def repeated_window_words(words: list, width: int = 3) -> int:
    """Words inside windows of ``width`` words that the list holds twice or more."""
    n = len(words)
    if n <= width:
        return 0
    codes = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64)
    window = codes[: n - width + 1]
    for k in range(1, width):
        pair = window * (int(codes.max()) + 1) + codes[k : n - width + 1 + k]
        # Numbered anew only where the next product could overflow.
        window = np.unique(pair, return_inverse=True)[1] if n > 1_000_000 else pair
    _, where, times = np.unique(window, return_inverse=True, return_counts=True)
    again = times[where] > 1
    covered = np.zeros(n, dtype=bool)
    for k in range(width):
        covered[k : n - width + 1 + k] |= again
    return int(covered.sum())


def rule_stats(text: str | None) -> tuple[int, ...]:
    """The counts named in ``STATS``; a null text counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(_GAPS)]
    return (
        len(words),
        len(text) - sum(map(text.count, _GAPS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_window_words(words),
        len(lines),
        len(raw) - len(raw.translate(None, _CAPITALS)),
        len(raw) - len(raw.translate(None, _DIGITS)),
        text.count("!") + text.count("?"),
        len(_BARE.findall(raw)),
    )


def stats_frame(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([rule_stats(x) for x in texts], columns=STATS, dtype="int64")


def rates(s: pd.DataFrame) -> np.ndarray:
    """What the forest splits on, one row per document."""
    words, chars, lines = (np.maximum(s[c], 1) for c in ("n_words", "word_chars", "n_lines"))
    return np.column_stack(
        [
            s.word_chars / words,
            # Roots give the low end, where documents differ, more room to be cut.
            np.sqrt(s.n_symbols / words),
            np.sqrt(s.n_dup_lines / lines),
            np.sqrt(s.n_repeat_words / words),
            np.sqrt(s.n_capitals / chars),
            np.sqrt(s.n_digits / chars),
            np.sqrt(s.n_marks / words),
            np.sqrt(s.n_bare / words),
            np.log1p(s.n_words / lines),
            np.log1p(s.n_words),
        ]
    ).astype(float)


def base_failed(s: pd.DataFrame) -> pd.Series:
    """Too short, or more than half of it repeated windows."""
    return (s.n_words < 50) | (100 * s.n_repeat_words > 50 * s.n_words)


def expected_path(n: np.ndarray) -> np.ndarray:
    """Mean depth at which one of ``n`` rows gets isolated by random splits."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + 0.5772156649015329
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays over nodes: split rate, cut, children, and path length at leaves."""

    feature: list
    cut: list
    child: list
    path: list
    rows: int
    threshold: float = 2.0  # above any score

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; the higher, the sooner random splits isolate the row."""
        depth = np.zeros(len(x))
        for feature, cut, child, path in zip(self.feature, self.cut, self.child, self.path, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            while (inner := feature[at] >= 0).any():
                f = np.maximum(feature[at], 0)
                right = x[np.arange(len(x)), f] >= cut[at]
                at = np.where(inner, child[at] + right, at)
            depth += path[at]
        return 2.0 ** (-(depth / max(1, len(self.feature))) / max(1e-9, float(expected_path(np.array(self.rows)))))


@dataclass
class Splits:
    """Complete trees of random splits: ``feature`` (-1 where the box is a point) and
    ``cut`` of the inner nodes, a row for each tree; node k leads to 2k + 1 and 2k + 2."""

    feature: np.ndarray
    cut: np.ndarray

    def counts(self, x: np.ndarray) -> np.ndarray:
        """How many of the rows end at each node, by tree."""
        trees, inner = self.feature.shape
        found = np.zeros((trees, 2 * inner + 1), dtype=np.int64)
        rows = np.arange(len(x))
        for own, feature, cut in zip(found, self.feature, self.cut, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                f = np.where(at < inner, feature[np.minimum(at, inner - 1)], -1)
                right = x[rows, np.maximum(f, 0)] >= cut[np.minimum(at, inner - 1)]
                at = np.where(f >= 0, 2 * at + 1 + right, at)
            own += np.bincount(at, minlength=len(own))
        return found


def random_splits(low: np.ndarray, high: np.ndarray, trees: int, levels: int, seed: int) -> Splits:
    """Splits at a random cut of a random side of each node's box, level by level."""
    rng = np.random.default_rng(seed)
    lo, hi = (np.broadcast_to(x, (trees, 1, len(low))) for x in (low, high))
    features, cuts = [], []
    for _ in range(levels):
        # Of the sides that are not a point, the one with the largest draw.
        draw = np.where(hi > lo, rng.random(lo.shape), -1.0)
        f = draw.argmax(axis=2)[..., None]
        left, right = np.take_along_axis(lo, f, 2), np.take_along_axis(hi, f, 2)
        cut = left + (right - left) * rng.random(left.shape)
        features.append(np.where(draw.max(axis=2) < 0, -1, f[..., 0]))
        cuts.append(cut[..., 0])
        chosen = np.arange(len(low)) == f
        lo = np.stack([lo, np.where(chosen, cut, lo)], axis=2).reshape(trees, -1, len(low))
        hi = np.stack([np.where(chosen, cut, hi), hi], axis=2).reshape(trees, -1, len(low))
    return Splits(np.concatenate(features, axis=1), np.concatenate(cuts, axis=1))


def weighed(splits: Splits, counts: np.ndarray, rows: int) -> Forest:
    """The forest of the splits, cut back to nodes that hold more than one of ``rows`` rows, as
    many as all counted ones weigh together."""
    trees, inner = splits.feature.shape
    mass = counts.astype(float)
    for k in range(inner - 1, -1, -1):
        mass[:, k] += mass[:, 2 * k + 1] + mass[:, 2 * k + 2]
    mass *= rows / max(1, int(counts[0].sum()))
    depth = np.frexp(np.arange(1, 2 * inner + 2))[1] - 1
    feature, cut = np.full((trees, 2 * inner + 1), -1), np.zeros((trees, 2 * inner + 1))
    feature[:, :inner] = np.where(mass[:, :inner] > 1, splits.feature, -1)
    cut[:, :inner] = splits.cut
    reached = np.zeros((trees, 2 * inner + 1), dtype=bool)
    reached[:, 0] = True
    for k in range(inner):
        reached[:, 2 * k + 1] = reached[:, 2 * k + 2] = reached[:, k] & (feature[:, k] >= 0)
    path = depth + expected_path(mass)
    grown = []
    for t in range(trees):
        kept = np.flatnonzero(reached[t])
        place = np.cumsum(reached[t]) - 1
        leaf = feature[t, kept] < 0
        child = np.where(leaf, 0, place[np.minimum(2 * kept + 1, 2 * inner)])
        grown.append((feature[t, kept], cut[t, kept], child, np.where(leaf, path[t, kept], 0.0)))
    return Forest(*map(list, zip(*grown, strict=True)), rows=rows)


def _levels(rows: int) -> int:
    return int(np.ceil(np.log2(max(2, rows)))) + 2


def grow_forest(good: np.ndarray, box: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 11) -> Forest:
    """A forest of rows in memory; ``fit`` does the same over a table."""
    size = min(tree_rows, len(good))
    splits = random_splits(box.min(axis=0), box.max(axis=0), trees, _levels(size), seed)
    return weighed(splits, splits.counts(good), size)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, good`` and the statistics of every labelled document, one row for each id.

    Ids labelled both good and bad, null ids and null labels are left out.  Statistics
    are taken where the texts lie, so that the join moves numbers only.
    """
    one = (
        labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
        .filter("low = high")
        .select("doc_id", (F.col("low") > 0).alias("good"))
    )

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.concat([b[["doc_id", "place"]].reset_index(drop=True), stats_frame(b.text)], axis=1)

    texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("place"))
    measured = texts.mapInPandas(measure, ", ".join(f"{c} long" for c in ("doc_id", "place", *STATS)))
    # An id may have several rows; the first text by hash stands for them.
    each = measured.groupBy("doc_id").agg(F.min(F.struct("place", *STATS)).alias("r"))
    return each.join(one, "doc_id").select("doc_id", "good", *(f"r.{c}" for c in STATS))


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> pd.DataFrame:
    """At most ``limit`` rows of :func:`labelled`, by a hash of their id, to look at; ``fit`` reads all."""
    rows = labelled(docs, labels).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(limit)
    return pd.DataFrame([tuple(r) for r in rows.select("good", *STATS).collect()], columns=["good", *STATS])


def _box(rows: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """The least and the largest of each rate; None without rows."""
    names = [f"{side}_{c}" for side in ("low", "high") for c in RATES]

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = rates(b)
                yield pd.DataFrame([[*x.min(axis=0), *x.max(axis=0)]], columns=names)

    found = rows.select(*STATS).mapInPandas(ends, ", ".join(f"{c} double" for c in names))
    r = found.agg(*((F.min if c.startswith("low_") else F.max)(c).alias(c) for c in names)).first()
    return None if r[0] is None else (np.array(r[: len(RATES)]), np.array(r[len(RATES) :]))


def _counted(good: DataFrame, splits: Splits) -> np.ndarray:
    """``splits.counts`` of all rows of a table."""
    shape = splits.feature.shape[0], 2 * splits.feature.shape[1] + 1

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros(shape, dtype=np.int64)
        for b in batches:
            found += splits.counts(rates(b))
        place = np.flatnonzero(found)
        yield pd.DataFrame({"place": place, "n": found.ravel()[place]})

    found = np.zeros(shape, dtype=np.int64)
    for r in good.select(*STATS).mapInPandas(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        found.flat[r.place] = r.n
    return found


def calibrate(scores: DataFrame, n_good: int, max_good_loss: float = MAX_GOOD_LOSS) -> float:
    """The lowest score (``good``, ``score``) that loses at most ``max_good_loss`` of the ``n_good``
    good rows, moved up to the middle of the gap before the next bad row."""
    # The score of that rank from above; the lost share is sorted, not all rows.
    lost = n_good - int(np.ceil((n_good - 1) * (1 - max_good_loss)))
    least = scores.filter("good").orderBy(F.desc("score")).limit(lost).agg(F.min("score")).first()[0]
    above = scores.filter(~F.col("good") & (F.col("score") > least)).agg(F.min("score")).first()[0]
    return least if above is None else (least + above) / 2


def fit(docs: DataFrame, labels: DataFrame, max_good_loss: float = MAX_GOOD_LOSS) -> Forest | None:
    """A calibrated forest of all labelled documents; None where none labelled good passes the base rules."""
    rows = written(labelled(docs, labels).filter("NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"), "labelled")
    good = rows.filter("good")
    n_good = good.count()
    if not n_good:
        return None
    size = min(TREE_ROWS, n_good)
    splits = random_splits(*_box(rows), TREES, _levels(size), seed=11)
    forest = weighed(splits, _counted(good, splits), size)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"good": b.good, "score": forest.score(rates(b))})

    scores = written(rows.select("good", *STATS).mapInPandas(score, "good boolean, score double"), "scores")
    forest.threshold = calibrate(scores, n_good, max_good_loss)
    forget(rows, scores)
    return forest


def judge(stats: pd.DataFrame, forest: Forest | None) -> pd.DataFrame:
    """``base_failed``, ``anomaly`` (the score, 0 without a forest) and ``kept``."""
    failed = base_failed(stats)
    score = np.zeros(len(stats)) if forest is None or not len(stats) else forest.score(rates(stats))
    limit = 2.0 if forest is None else forest.threshold
    return pd.DataFrame({"base_failed": failed, "anomaly": score, "kept": ~failed & (score <= limit)})


def verdicts(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): statistics and verdict.

    A null or empty text has no words and fails the base rules.  Repeated rows
    get one verdict each, the same for the same text.  An empty table gives no
    rows; other columns are not read.  Without a forest the base rules decide.
    """
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.LongType()) for c in STATS)]
        + [T.StructField("base_failed", T.BooleanType()), T.StructField("anomaly", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = stats_frame(b.text)
            yield pd.concat([b.doc_id.reset_index(drop=True).astype("Int64"), s, judge(s, forest)], axis=1)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, schema)


def keep_good(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """The rows of ``docs`` whose text is kept, with all their columns.

    Null and empty texts go, repeated rows share one verdict, an empty table
    gives no rows.
    """

    @F.pandas_udf("boolean")
    def good(text: pd.Series) -> pd.Series:
        return judge(stats_frame(text), forest).kept

    return docs.filter(good("text"))
