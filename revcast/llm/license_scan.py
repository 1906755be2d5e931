"""License scans: MinHash bands over overlapping windows, then exact containment.

Documents and templates are cut into windows of ``WINDOW`` words (documents at
every ``STEP``-th word, templates at every word).  A window's ``BANDS`` minimum
hashes over its three-word shingles are bands of one row each; a window that
shares a band with a template's window is a candidate.  A template of three
words or more that a document holds shares a band with a probability of at
least 0.998 (worst case: one shingle of three in one window, 1 - (2/3)**16),
and longer ones meet in many windows.

Candidates are decided by the share of the template's distinct shingles that
the surrounding stretch of the document holds.

All of it runs in one pass over the documents on Spark's own expressions; only
found (document, template) pairs are shuffled.  Template tables are small and
fixed by the caller, so their band values stand in the plan as literals and the
templates are broadcast.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revcast.llm.license_texts import NOTICES

SHINGLE, WINDOW, STEP, BANDS = 3, 5, 3, 16
CONTAINED_PERCENT = 80
#: The templates are literals of the plan; more than this many are refused.
MOST_TEMPLATES = 2_000

_WORDS = "filter(split(lower(coalesce({text}, '')), '[^a-z0-9]+'), w -> w <> '')"
_HASHES = (
    f"if(size(words) >= {SHINGLE}, transform(sequence(0, size(words) - {SHINGLE}), "
    "i -> xxhash64(get(words, i), get(words, i + 1), get(words, i + 2))), cast(array() as array<bigint>))"
)


def _masks() -> list[int]:
    rng = random.Random(20)
    return [rng.getrandbits(64) - (1 << 63) for _ in range(BANDS)]


#: The order of shingles in a band is that of their hashes under a fixed mask.
MASKS = _masks()


def _band_value(k: int, start: str) -> str:
    own = ", ".join(f"get(hashes, {start} + {j}) ^ {MASKS[k]}" for j in range(WINDOW - SHINGLE + 1))
    return f"least({own})"


def _bound(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once for a row."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def shingled(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """``keep``, ``n_words`` and ``hashes``: the hash of each three-word shingle of the text, in order."""
    both = f"named_struct('n_words', size(words), 'hashes', {_HASHES})"
    found = rows.select(*keep, F.expr(_bound("words", _WORDS.format(text=text), both)).alias("s"))
    return found.select(*keep, "s.n_words", "s.hashes")


def template_table(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """``template, license, t_words, t_hashes`` of the templates that have three words or more."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"{len(templates)} templates; at most {MOST_TEMPLATES}")
    rows = [(i, name, text) for i, (name, text) in enumerate(templates)]
    given = spark.createDataFrame(rows, "template int, license string, text string")
    return shingled(given, "text", "template", "license").filter("size(hashes) > 0").select(
        "template", "license", F.col("n_words").alias("t_words"), "hashes", F.expr("array_distinct(hashes)").alias("t_hashes")
    )


def scan(docs: DataFrame, templates: list[tuple[str, str]] = NOTICES, percent: int = CONTAINED_PERCENT) -> DataFrame:
    """``doc_id, template, license, containment, first_word, n_places`` of the templates found.

    ``template`` is the place in the list; ``containment`` the largest share of
    its shingles at one place, ``first_word`` the first window (by word, from 0)
    at which it was confirmed, ``n_places`` the number of such windows.  Null
    and empty texts hold nothing; rows that share an id are merged, a null id is
    an id of its own; without templates or documents there are no rows.  Other
    columns are not read.
    """
    spark = docs.sparkSession
    table = template_table(spark, templates)
    bands = table.select(
        "template",
        F.explode(F.expr(f"sequence(0, greatest(0, size(hashes) - {WINDOW - SHINGLE + 1}))")).alias("s"),
        "hashes",
    ).select(
        "template", F.posexplode(F.expr("array(" + ", ".join(_band_value(k, "s") for k in range(BANDS)) + ")")).alias("band", "value")
    ).distinct()
    known: list[set[int]] = [set() for _ in range(BANDS)]
    longest = 0
    for r in bands.collect():  # bounded by the templates
        known[r["band"]].add(r["value"])
    for r in table.select("t_words").collect():
        longest = max(longest, r["t_words"])
    result = "doc_id", "template", "license", "containment", "first_word", "n_places"
    if not longest:
        empty = "doc_id long, template int, license string, containment double, first_word int, n_places long"
        return spark.createDataFrame([], empty).select(*result)

    hit = " OR ".join(f"{_band_value(k, 's')} IN ({', '.join(map(str, sorted(known[k])))})" for k in range(BANDS))
    values = "array(" + ", ".join(_band_value(k, "s") for k in range(BANDS)) + ")"
    around = f"slice(hashes, greatest(0, s - {longest}) + 1, {2 * longest + WINDOW})"
    starts = f"if(size(hashes) > 0, sequence(0, size(hashes) - 1, {STEP}), cast(array() as array<int>))"
    found = f"transform(filter({starts}, s -> {hit}), s -> named_struct('s', s, 'bands', {values}, 'around', {around}))"
    per_doc = _bound("words", _WORDS.format(text="text"), _bound("hashes", _HASHES, found))
    # The outer form, as the inner one would have Spark compute the array twice to skip empty ones early.
    places = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.inline_outer(F.expr(per_doc))).filter("s IS NOT NULL")
    )
    candidates = (
        places.select("doc_id", "s", "around", F.posexplode("bands").alias("band", "value"))
        .join(F.broadcast(bands), ["band", "value"])
        .join(F.broadcast(table.select("template", "license", "t_words", "t_hashes")), "template")
    )
    # The stretch that the template could cover if the window lies in it.
    stretch = f"slice(around, greatest(0, s - t_words) - greatest(0, s - {longest}) + 1, 2 * t_words + {WINDOW})"
    held = candidates.withColumn("held", F.expr(f"size(array_intersect(t_hashes, {stretch}))")).filter(
        f"100 * held >= {percent} * size(t_hashes)"
    )
    return (
        held.groupBy("doc_id", "template", "license")
        .agg(
            F.max(F.expr("held / size(t_hashes)")).alias("containment"),
            F.min("s").alias("first_word"),
            F.count_distinct("s").alias("n_places"),
        )
        .select(*result)
    )
