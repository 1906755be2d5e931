"""Main text of web pages by host suffix arrays.

The words around the articles of a host's pages are concatenated into one
stream, page after page with a separator that is unlike anything else, and the
stream's suffixes are sorted by prefix doubling to the depth of the shortest
run that counts (eight words).  Suffixes that are equal to that depth lie
side by side; where they come from enough distinct pages of the host, their
words are boilerplate.  Covered words are removed and the unique runs stay.

Words inside an article that the markup declares are kept whatever repeats:
hosts republish articles, and a run that repeats because of that is still the
main text of each page.  Likewise parts that the markup declares to be menus,
adverts, forms or comments never enter a page's text, repeated or not, though
they take part in the streams.  For the blocks that no markup decides on, the
suffix array does.

A host of any size is spread over tasks by range partitioning; each task sorts
streams of a bounded size.  Of hosts that may continue in another task or
stream, the runs are summed over the host before they are judged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revcast.llm.common import written
from revcast.llm.html_blocks import ARTICLE, FRAME, OPEN, blocks

#: Words of the shortest run, a power of two, and the distinct pages it must stand on.
MIN_RUN, MIN_PAGES = 8, 3
#: Words of one suffix array, and of a task.
STREAM_WORDS, TASK_WORDS = 2_000_000, 4_000_000

_U = np.uint64


def host_of(url: str | Column = "url") -> Column:
    """The host part of an address, in lower case without user and port; empty where there is none."""
    rest = F.regexp_replace(F.lower(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))), r"^[a-z][a-z0-9+.-]*:", "")
    return F.regexp_extract(rest, r"^//(?:[^/?#@]*@)?([^/?#:]*)", 1)


def page_key() -> Column:
    """Rows equal in id, address and source are one page."""
    return F.xxhash64("page_id", "url", "html")


def outside_words(source: str | None) -> list[str]:
    """The words of all blocks outside the declared article, in page order."""
    return [w for b in blocks(source) if b.place != ARTICLE for w in b.text.split()]


def repeated_suffixes(words: np.ndarray, depth: int = MIN_RUN) -> tuple[np.ndarray, np.ndarray]:
    """Starts of suffixes in sorted order, and the rank of each up to ``depth`` words.

    ``words`` are numbers; the array is closed by separators at least as far as
    ``depth`` reaches.  Equal ranks are equal runs.
    """
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    reach = 1
    while reach < depth:
        behind = np.concatenate([rank[reach:], np.full(min(reach, len(rank)), -1)]) + 1
        rank = np.unique(rank * (int(behind.max()) + 1) + behind, return_inverse=True)[1].astype(np.int64)
        reach *= 2
    order = np.argsort(rank, kind="stable")
    return order, rank[order]


def _run_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    n = max(0, len(hashes) - width + 1)
    found = np.zeros(n, dtype=_U)
    for k in range(width):
        found = (found ^ hashes[k : k + n]) * _U(0x9E3779B97F4A7C15)
        found ^= found >> _U(29)
    return found


def stream_runs(streams: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ``MIN_RUN`` words in one host's streams, in the order of the suffix array.

    For each start of a run: page, word in the page, hash of the run, and the number
    of distinct pages that hold it.
    """
    lengths = np.array([len(s) for s in streams])
    flat = np.array([w for s in streams for w in s], dtype=object)
    if not len(flat):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty.astype(_U), empty
    codes, names = pd.factorize(flat)
    hashes = pd.util.hash_array(np.array(names, dtype=object), categorize=False).astype(_U)[codes]
    # A separator of its own behind each page keeps runs inside pages.
    page = np.repeat(np.arange(len(streams)), lengths + 1)
    within = np.concatenate([np.arange(n + 1) for n in lengths])
    is_word = within < lengths[page]
    text = np.where(is_word, 0, len(names) + page)
    text[is_word] = codes
    order, rank = repeated_suffixes(text)
    full = within[order] + MIN_RUN <= lengths[page[order]]
    order, rank = order[full], rank[full]
    if not len(order):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty.astype(_U), empty
    # Distinct pages of each group of equal suffixes; starts of a group are in stream order, so pages are too.
    group = np.concatenate(([0], np.cumsum(rank[1:] != rank[:-1])))
    new_page = np.concatenate(([True], (group[1:] != group[:-1]) | (page[order][1:] != page[order][:-1])))
    pages = np.bincount(group, weights=new_page).astype(np.int64)[group]
    spread = np.zeros(len(text), dtype=_U)
    spread[is_word] = hashes
    runs = _run_hashes(spread, MIN_RUN)
    return page[order], within[order], runs[order], pages


def _judged(host: str, keys: list[int], streams: list[list[str]], whole: bool, min_pages: int) -> pd.DataFrame:
    """Rows ``host, run, pages, keys, starts``.

    Runs on enough pages of this stream are gathered under the null run.  Of a host that
    may not be whole here, every run follows with its count, and with its places if these
    are not gathered already.
    """
    page, start, run, pages = stream_runs(streams)
    keys_of = np.array(keys, dtype=np.int64)
    sure = pages >= min_pages
    rows = []
    if sure.any():
        rows.append((host, None, min_pages, keys_of[page[sure]], start[sure]))
    if not whole:
        for own in np.split(np.arange(len(run)), np.flatnonzero(run[1:] != run[:-1]) + 1) if len(run) else ():
            if sure[own[0]]:
                own_keys, own_starts = keys_of[:0], start[:0]
            else:
                own_keys, own_starts = keys_of[page[own]], start[own]
            rows.append((host, int(run[own[0]].astype(np.int64)), int(pages[own[0]]), own_keys, own_starts))
    found = pd.DataFrame(rows, columns=["host", "run", "pages", "keys", "starts"])
    # Not by way of floats, which hold 53 bits of a run's hash.
    return found.assign(run=pd.array([r[1] for r in rows], dtype="Int64"))


def boilerplate(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """``key, starts``: for each page, where covered runs of ``MIN_RUN`` outside words start."""

    @F.pandas_udf("array<string>")
    def outside(sources: pd.Series) -> pd.Series:
        return pd.Series([outside_words(s) for s in sources])

    streams = written(
        pages.select(host_of().alias("host"), page_key().alias("key"), outside("html").alias("words"))
        .filter(f"size(words) >= {MIN_RUN}")
        .dropDuplicates(["host", "key"]),
        "streams",
    )
    total = streams.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, keys, own, size = None, [], [], 0
        for b in batches:
            for h, key, words in zip(b.host, b.key, b.words, strict=True):
                if keys and (h != host or size >= STREAM_WORDS):
                    yield _judged(host, keys, own, False, min_pages)
                    keys, own, size = [], [], 0
                host = h
                keys.append(key)
                own.append(list(words))
                size += len(words)
        if keys:
            yield _judged(host, keys, own, False, min_pages)

    tasks = max(1, -(-total // TASK_WORDS))
    runs = written(
        streams.repartitionByRange(tasks, "host", "key")
        .sortWithinPartitions("host", "key")
        .mapInPandas(sort, "host string, run long, pages long, keys array<long>, starts array<int>"),
        "runs",
    )
    counted = runs.filter("run IS NOT NULL")
    often = counted.groupBy("host", "run").agg(F.sum("pages").alias("n")).filter(F.col("n") >= min_pages).select("host", "run")
    found = runs.filter("run IS NULL").unionByName(counted.filter("size(keys) > 0").join(often, ["host", "run"]).select(*runs.columns))
    places = found.select(F.explode(F.arrays_zip("keys", "starts")).alias("p"))
    return written(
        places.groupBy(F.col("p.keys").alias("key")).agg(F.collect_set("p.starts").alias("starts")), "boilerplate"
    )


def main_text(source: str | None, starts) -> tuple[str, int]:
    """The page's text, and the number of its words outside the article that repeated runs cover.

    Blocks that the markup leaves open lose their covered words.  Where this
    would leave nothing, as on a page that repeats as a whole, they stay.
    """
    own = blocks(source)
    n = sum(len(b.text.split()) for b in own if b.place != ARTICLE)
    covered = np.zeros(n, dtype=bool)
    for s in starts if starts is not None else ():
        covered[s : s + MIN_RUN] = True
    kept, at = [], 0
    for b in own:
        if b.place == ARTICLE:
            kept.append(b.text)
            continue
        words = b.text.split()
        gone = covered[at : at + len(words)]
        at += len(words)
        if b.place == OPEN:
            kept.append(" ".join(w for w, g in zip(words, gone, strict=True) if not g))
    text = "\n".join(t for t in kept if t)
    return text or "\n".join(b.text for b in own if b.place != FRAME), int(covered.sum())


def extract(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """``page_id, url, text, n_chars, n_repeated`` for each row of ``pages`` (``page_id``, ``url``, ``html``).

    A null or empty page has an empty text.  Pages without a host in their
    address are pages of one nameless host.  Rows equal in all three columns are
    one page for the counts and each get a row.  ``n_chars`` counts code points;
    ``n_repeated`` counts the words outside the declared article that runs on
    ``min_pages`` pages of the host cover.  An empty table gives no rows; other
    columns are not read.
    """

    @F.pandas_udf("text string, n_chars long, n_repeated long")
    def run(sources: pd.Series, starts: pd.Series) -> pd.DataFrame:
        rows = [main_text(s, at) for s, at in zip(sources, starts, strict=True)]
        return pd.DataFrame([(t, len(t), n) for t, n in rows], columns=["text", "n_chars", "n_repeated"])

    own = pages.select("page_id", "url", "html")
    covered = boilerplate(own, min_pages).withColumnRenamed("key", "__key")
    joined = own.join(covered, page_key() == F.col("__key"), "left")
    return joined.select("page_id", "url", run("html", "starts").alias("r")).select("page_id", "url", "r.*")
