"""Language ID by compression: one zstandard raw-content dictionary per language.

A text belongs to the language whose dictionary makes it smallest.  The
dictionaries are plain text of that language, drawn from labelled documents; a
text that shares words and word parts with one needs fewer bytes.  Texts and
dictionaries are reduced to lower-cased letter runs first.  Where the two
smallest sizes lie close together the verdict is marked as not confident.

Only the dictionaries come from a sample (at most ``DICT_BYTES`` of lower-cased
text for each language, taken in the order of a hash of the text); every
document is classified from its whole text.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of text in a dictionary, and the most documents read to fill one.
DICT_BYTES, DICT_DOCS = 112_640, 400
#: Short matches and a search by binary trees, which short texts need.
LEVEL, SEARCH = 6, {"min_match": 4, "strategy": zstandard.STRATEGY_BTLAZY2}
#: A margin below both of these, in bytes and as a share of the best size, is narrow.
NARROW_BYTES, NARROW_SHARE = 3, 0.02
UNDETERMINED = "und"



def _marks() -> str:
    """Ranges of the combining marks, which carry the vowels of many scripts, for a character class."""
    marks = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Mn", "Mc")]
    first = [c for c, before in zip(marks, [-2, *marks], strict=False) if c != before + 1]
    last = [c for c, behind in zip(marks, [*marks[1:], -2], strict=True) if c != behind - 1]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(first, last, strict=True))


_LETTERS = re.compile(rf"[^\W\d_]+(?:[{_marks()}]+[^\W\d_]*)*")


def letter_runs(text: str) -> bytes:
    """The lower-cased letter runs of a text, with the marks on their letters, joined by one space."""
    return " ".join(_LETTERS.findall(text.lower())).encode("utf-8", "surrogatepass")


def train(docs: DataFrame, dict_bytes: int = DICT_BYTES, dict_docs: int = DICT_DOCS) -> dict[str, bytes]:
    """Dictionary by language, the one with most rows first, from ``text`` and ``lang`` of ``docs``; null or empty ones teach nothing.

    Equal texts count once.  At most ``dict_docs`` texts of each language are
    drawn, by hash; the share of texts that is looked at shrinks as
    the distinct texts of a language grow, so that no task gathers more than a few
    times that many, and all of them are looked at where they are few.  Tasks cut
    each to the letter runs that a dictionary holds, and those that come
    after a full dictionary stay there, so that less than two dictionaries of
    a language reach the driver.
    """
    known = docs.filter("lang IS NOT NULL AND length(text) > 0").select("lang", "text")
    order = F.xxhash64("text")
    # Copies of a text are combined before the shuffle.
    texts = known.groupBy("lang", order.alias("order")).count()
    tallies = texts.groupBy("lang").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("distinct")).collect()
    counts = {r["lang"]: r["n"] for r in tallies}
    if not counts:
        return {}
    shares = {r["lang"]: min(1.0, 6 * dict_docs / r["distinct"]) for r in tallies}
    share = F.create_map(*(F.lit(x) for lang in sorted(shares) for x in (lang, shares[lang])))
    drawn = (
        known.withColumn("order", order)
        .filter(F.pmod("order", F.lit(1_000_003)) <= F.element_at(share, F.col("lang")) * 1_000_003)
        .dropDuplicates(["lang", "order"])
    )

    @F.pandas_udf("binary")
    def runs(texts: pd.Series) -> pd.Series:
        return pd.Series([letter_runs(x)[:dict_bytes] for x in texts])

    by_order = Window.partitionBy("lang").orderBy("order")
    first = drawn.withColumn("place", F.row_number().over(by_order)).filter(F.col("place") <= dict_docs)
    cut = first.select("lang", "order", runs("text").alias("runs"))
    # Each takes the byte of a line's end, too.
    filled = F.sum(F.octet_length("runs") + 1).over(by_order.rowsBetween(Window.unboundedPreceding, -1))
    rows = cut.withColumn("filled", F.coalesce(filled, F.lit(0))).filter(F.col("filled") < dict_bytes).collect()
    found: dict[str, bytes] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["order"])):
        own = found.get(r["lang"], b"")
        found[r["lang"]] = own + bytes(r["runs"])[: dict_bytes - len(own)] + b"\n"
    return {lang: found[lang] for lang in sorted(found, key=lambda x: (-counts[x], x))}


class Classifier:
    """Compressors for the dictionaries of :func:`train`; built once in each task."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = list(dictionaries)
        self.by_lang = []
        for own in dictionaries.values():
            content = zstandard.ZstdCompressionDict(own, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, dict_size=len(own), write_content_size=0, write_checksum=0, **SEARCH
            )
            content.precompute_compress(compression_params=how)
            self.by_lang.append(zstandard.ZstdCompressor(dict_data=content, compression_params=how))

    def sizes(self, text: str) -> list[int]:
        raw = letter_runs(text)
        return [len(c.compress(raw)) for c in self.by_lang]

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score (0 to 1, higher for a wider margin) and whether the margin is wide."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, False
        sizes = self.sizes(text)
        best = min(sizes)
        at = sizes.index(best)
        score = 1.0 / sum(math.pow(2.0, -min(60, s - best)) for s in sizes)
        second = min((s for k, s in enumerate(sizes) if k != at), default=2 * best)
        wide = second - best >= NARROW_BYTES or second - best >= NARROW_SHARE * best
        return self.langs[at], score, wide


def held_out() -> Column:
    """Rows that are never learned from: crc32 of the id as text is divisible by 5 (null id: as empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def predict(docs: DataFrame, dictionaries: dict[str, bytes], keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the columns in ``keep``, ``lang_pred``, ``score``, ``confident``.

    Only the text is looked at.  ``und`` with score 0 stands for a null or empty
    text, one without letters, and any text when nothing was learned.  Ties go
    to the language with most labelled rows.  Repeated rows each get a row, an
    empty table gives none, and other columns are not read.
    """

    @F.pandas_udf("lang_pred string, score double, confident boolean")
    def classify(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classifier = Classifier(dictionaries)
        for part in texts:
            found = [classifier.classify(x) for x in part]
            yield pd.DataFrame(found, columns=["lang_pred", "score", "confident"])

    kept = [F.col(c) for c in keep or []]
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *kept, classify("text").alias("__found"))
    return found.select("doc_id", *kept, "__found.lang_pred", "__found.score", "__found.confident")
