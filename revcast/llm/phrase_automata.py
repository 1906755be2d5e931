"""Substring dedup by repeated-phrase automata.

A window of 20 words is removed where its words also start earlier: in a
document with a smaller id, or further left in the same one.  The steps are

1. copies: whole copies of a text take part once.  Their smallest id stands for
   them, the others lose every window;
2. candidates: every window is known by its anchor, the six-word run in it
   with the smallest hash.  Equal windows have equal anchors, and about one
   position in eight is an anchor, so counting anchors moves far less than
   counting windows.  Only windows whose anchor occurs twice go on;
3. confirmation: these windows are counted by hash, and the first place of each
   that recurs is noted;
4. automata: the recurring windows, read from their first place, are compiled
   into Aho-Corasick automata, one per shard of anchors;
5. location: the passages around the recurring anchors of all documents stream
   through the automaton of their shard, which finds every occurrence of every
   recurring window by its words, not its hash.  Passages of the same words in
   a task are searched once.

An automaton holds a bounded number of windows: those of an anchor that has more
(a line that a third of all documents hold in ever new contexts) are dealt over
shards of its own by the words of the window, and a passage goes to the shards of
the windows that it holds.  A shard whose passages are many is dealt over several
tasks with the same automaton.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revcast.llm.common import forget, under_plain_names, whole_text, written

WINDOW, ANCHOR = 20, 6
#: About this many windows in an automaton, and passages that one task streams through it.
#: The automaton tries a node's branches one by one, so that a small one is faster for each word.
SHARD_WINDOWS, TASK_PASSAGES = 4_000, 100_000
#: Rows that a task gathers before it hands them on.
FLUSH_ROWS = 200_000

_U = np.uint64


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words, put together from runs of 1, 2, 4, ... words."""
    n = len(hashes) - width + 1
    found, done, part, size = np.zeros(n, dtype=_U), 0, hashes, 1
    while True:
        if width & size:
            found = _mix(found * _U(0x9E3779B97F4A7C15) + part[done : done + n])
            done += size
        if done == width:
            return found
        part = _mix(part[:-size] * _U(0x9E3779B97F4A7C15) + part[size:])
        size *= 2


def _first_least(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest of each ``width`` values in a row, the leftmost of equal ones."""
    at, size = np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        right = values[step:] < values[:-step]
        at = np.where(right, at[step:], at[:-step])
        values = np.where(right, values[step:], values[:-step])
        size += step
    return at


class Anchored:
    """A text's words, the anchor position of each window and the anchors' hashes."""

    def __init__(self, text: str | None, window: int = WINDOW):
        self.words = words_of(text)
        self.window = window
        self.n_windows = max(0, len(self.words) - window + 1)
        if self.n_windows:
            self.hashes = pd.util.hash_array(np.array(self.words, dtype=object), categorize=False).astype(_U)
            width = min(ANCHOR, window)
            grams = _runs(self.hashes, width)
            # The leftmost of equal ones: the same choice wherever the window stands.
            self.anchor_of = _first_least(grams, window - width + 1)
            # They only move to the right.
            self.anchors = self.anchor_of[np.append(True, np.diff(self.anchor_of) > 0)]
            self.keys = grams[self.anchors].astype(np.int64)

    def window_hashes(self) -> np.ndarray:
        return _runs(self.hashes, self.window)

    def excerpts(self, firsts: np.ndarray, lasts: np.ndarray) -> list[str]:
        """The words of the windows that start at each of ``firsts`` to ``lasts``."""
        cuts = zip(firsts.tolist(), (lasts + self.window).tolist(), strict=True)
        return [b" ".join(self.words[f:e]).decode("utf-8", "surrogatepass") for f, e in cuts]


def _ids(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def text_key() -> Column:
    return F.unhex(F.md5(whole_text("text").cast("binary")))


def _anchor_rows(texts: DataFrame, window: int) -> DataFrame:
    """``key, doc_id, at`` of every anchor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, ids, at = [], [], []
            for doc_id, text in zip(b.doc_id, b.text, strict=True):
                a = Anchored(text, window)
                if a.n_windows:
                    keys.append(a.keys)
                    ids.append(np.full(len(a.keys), doc_id, np.int64))
                    at.append(a.anchors.astype(np.int32))
            if keys:
                yield pd.DataFrame({"key": np.concatenate(keys), "doc_id": np.concatenate(ids), "at": np.concatenate(at)})

    return texts.mapInPandas(run, "key long, doc_id long, at int")


def _stacked(found: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(("hash", "doc_id", "start", "n"), map(np.concatenate, zip(*found, strict=True)), strict=True)))


def _candidate_windows(held: DataFrame, window: int) -> DataFrame:
    """``hash, doc_id, start, n`` of the windows of ``held`` (``doc_id, text, ats``) whose
    anchor is in ``ats``: for equal windows of a document the first start and their number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found, size = [], 0
            for doc_id, text, ats in zip(b.doc_id, b.text, b.ats, strict=True):
                a = Anchored(text, window)
                starts = np.flatnonzero(np.isin(a.anchor_of, ats)) if a.n_windows else []
                if len(starts):
                    hashes, first, n = np.unique(a.window_hashes()[starts], return_index=True, return_counts=True)
                    found.append((hashes.astype(np.int64), np.full(len(hashes), doc_id, np.int64), starts[first].astype(np.int32), n.astype(np.int32)))
                    size += len(hashes)
                if size >= FLUSH_ROWS:
                    yield _stacked(found)
                    found, size = [], 0
            if found:
                yield _stacked(found)

    return held.mapInPandas(run, "hash long, doc_id long, start int, n int")


def _lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    """Each row's values, none for null."""
    values, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return (values[b:e] for b, e in zip(ends[:-1], ends[1:], strict=True))


def _list_column(sizes: list[np.ndarray], values: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate(values).astype(np.int32))


def _excerpts(held: DataFrame, window: int) -> DataFrame:
    """``key, doc_id, first, offsets, chosen, words``: by anchor, the windows of ``held``
    (``doc_id, text, ats, starts``) whose anchor is in ``ats``, and those of them that start
    at one of ``starts``."""

    def stacked(keys, ids, firsts, sizes, offsets, chosen_sizes, chosen, words) -> pa.RecordBatch:
        columns = [pa.array(np.concatenate(keys)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(firsts).astype(np.int32))]
        columns += [_list_column(sizes, offsets), _list_column(chosen_sizes, chosen), pa.array([w for own in words for w in own], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "first", "offsets", "chosen", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, size = [], 0
            rows = zip(b.column("doc_id").to_pylist(), b.column("text"), _lists(b.column("ats")), _lists(b.column("starts")), strict=True)
            for doc_id, text, ats, starts in rows:
                a = Anchored(text.as_py(), window)
                within = np.flatnonzero(np.isin(a.anchor_of, ats)) if a.n_windows else ()
                if not len(within):
                    continue
                is_start = np.zeros(a.n_windows, dtype=bool)
                is_start[starts[starts < a.n_windows]] = True
                anchor, mark = a.anchor_of[within], is_start[within]
                begins = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
                sizes = np.diff(np.append(begins, len(within)))
                firsts = within[begins]
                offsets = within - np.repeat(firsts, sizes)
                keys = a.keys[np.searchsorted(a.anchors, anchor[begins])]
                words = a.excerpts(firsts, within[begins + sizes - 1])
                ids = np.full(len(begins), doc_id, np.int64)
                found.append((keys, ids, firsts, sizes, offsets, np.add.reduceat(mark.astype(np.int64), begins), offsets[mark], words))
                size += len(begins)
                if size >= FLUSH_ROWS // 4:
                    yield stacked(*zip(*found, strict=True))
                    found, size = [], 0
            if found:
                yield stacked(*zip(*found, strict=True))

    schema = "key long, doc_id long, first int, offsets array<int>, chosen array<int>, words string"
    return held.select("doc_id", "text", "ats", "starts").mapInArrow(run, schema)


def _in_shards(excerpts: DataFrame, hot: DataFrame, shards: int, window: int) -> DataFrame:
    """``excerpts`` with their ``shard``; those of anchors in ``hot`` (``key, parts``) once
    for each of the anchor's shards that has some of their windows, with the offsets of these."""
    part_of = f"transform(offsets, k -> pmod(xxhash64(slice(split(words, ' '), k + 1, {window})), parts))"
    # A file of known size: Spark broadcasts it only while it is small.
    own = excerpts.join(hot, "key", "left").withColumn("part_of", F.expr(f"if(parts IS NULL, NULL, {part_of})"))
    own = own.withColumn("part", F.explode_outer(F.array_distinct("part_of")))
    return own.select(
        *(c for c in excerpts.columns if c != "offsets"),
        F.expr("if(part IS NULL, offsets, filter(offsets, (k, i) -> get(part_of, i) = part))").alias("offsets"),
        F.expr(f"if(part IS NULL, pmod(xxhash64(key), {shards}), xxhash64(key, part))").alias("shard"),
    )


def _in_runs(places: Iterator[int]) -> list[tuple[int, int]]:
    """The first and last of each run of rising places without a gap."""
    runs: list[tuple[int, int]] = []
    for k in places:
        if runs and runs[-1][1] + 1 == k:
            runs[-1] = (runs[-1][0], k)
        else:
            runs.append((k, k))
    return runs


def locate(patterns: pd.DataFrame, passages: pd.DataFrame, window: int = WINDOW) -> pd.DataFrame:
    """``doc_id, first, last``: runs of starts, in the passages, of windows that are among
    the patterns and stand earlier there."""
    number: dict[str, int] = {}
    known: dict[tuple, int] = {}
    earliest: list[tuple[int, int]] = []
    for doc_id, first, offsets, words in zip(patterns.doc_id.tolist(), patterns["first"].tolist(), patterns.offsets, patterns.words, strict=True):
        ids = tuple([number.setdefault(w, len(number) + 1) for w in words.split(" ")])
        for k in map(int, offsets):
            at = known.setdefault(ids[k : k + window], len(earliest))
            if at == len(earliest):
                earliest.append((doc_id, first + k))
            else:
                earliest[at] = min(earliest[at], (doc_id, first + k))
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for own, at in known.items():
        automaton.add_word(own, at)
    found: list[tuple[int, int, int]] = []
    if earliest:
        automaton.make_automaton()
        # For the words of a passage: the windows in them, their runs, and the largest document that any of them stands in first.
        searched: dict[str, tuple[list, list, int]] = {}
        for doc_id, first, words in zip(passages.doc_id.tolist(), passages["first"].tolist(), passages.words, strict=True):
            held = searched.get(words)
            if held is None:
                ids = tuple(map(number.get, words.split(" "), repeat(0)))
                windows = [(end - window + 1, earliest[pattern]) for end, pattern in automaton.iter(ids)]
                held = searched[words] = (windows, _in_runs(k for k, _ in windows), max((place[0] for _, place in windows), default=0))
            windows, runs, latest = held
            if windows and latest >= doc_id:
                runs = _in_runs(k for k, place in windows if place < (doc_id, first + k))
            found += [(doc_id, first + k, first + last) for k, last in runs]
    return pd.DataFrame(found, columns=["doc_id", "first", "last"])


def _later_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, copies``: by document, the keys of its texts that one with a smaller id has too."""
    texts = written(_ids(docs).filter("doc_id IS NOT NULL").select("doc_id", text_key().alias("key")).distinct(), "text-keys")
    groups = texts.groupBy("key").agg(F.min("doc_id").alias("earliest"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = written(groups, "copied")
    later = texts.join(groups.hint("merge"), "key").filter("doc_id > earliest")
    copies = written(later.groupBy("doc_id").agg(F.collect_set("key").alias("copies")), "copies")
    forget(texts, groups)
    return copies


def _is_copy(copies: str = "copies") -> Column:
    return F.when(F.col(copies).isNotNull(), F.array_contains(copies, text_key())).otherwise(F.lit(False))


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """What to remove, by document: ``doc_id, spans`` (runs of window starts) and ``copies``
    (keys of texts that are later copies as a whole); either may be null."""
    copies = _later_copies(docs)
    texts = _ids(docs).filter("doc_id IS NOT NULL")
    apart = texts
    if not copies.isEmpty():
        apart = texts.join(copies.hint("merge"), "doc_id", "left").filter(~_is_copy()).select("doc_id", "text")

    anchors = written(_anchor_rows(apart, window), "anchors")
    recurring = written(anchors.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "recurring")
    # The positions of one document are no more than its words.
    hits = anchors.join(recurring.hint("merge"), "key").groupBy("doc_id").agg(F.collect_set("at").alias("ats"))
    hits = written(hits.join(copies.hint("merge"), "doc_id", "left"), "hits")
    forget(anchors, recurring)
    held = written(texts.join(hits.hint("merge"), "doc_id").filter(~_is_copy()).select("doc_id", "text", "ats"), "held")
    forget(hits)

    # A document has one row for a window, so the smallest id decides its start.
    places = _candidate_windows(held, window).groupBy("hash")
    counted = places.agg(F.min("doc_id").alias("first_doc"), F.min_by("start", "doc_id").alias("start"), F.sum("n").alias("times"))
    confirmed = written(counted.filter("times > 1").select(F.col("first_doc").alias("doc_id"), "start"), "confirmed")
    shards = max(1, confirmed.count() // SHARD_WINDOWS)
    starts = confirmed.groupBy("doc_id").agg(F.collect_list("start").alias("starts"))
    table = written(_excerpts(held.join(starts.hint("merge"), "doc_id", "left"), window), "passages")
    forget(confirmed, held)
    # Under columns of its own, as both sides of the search come from one table.
    first = table.filter("size(chosen) > 0").select("key", "doc_id", "first", F.col("chosen").alias("offsets"), "words")
    first = first.toDF(*first.columns)
    hot = first.groupBy("key").agg(F.sum(F.size("offsets")).alias("n")).filter(f"n > {SHARD_WINDOWS}")
    # Fewer rows than there are shards.
    hot = written(hot.select("key", F.expr(f"1 + n div {SHARD_WINDOWS}").alias("parts")), "hot-anchors")
    patterns = _in_shards(first, hot, shards, window)
    passages = _in_shards(table.drop("chosen"), hot, shards, window).drop("offsets")
    tasks = passages.groupBy("shard").agg(F.expr(f"1 + count(*) div {TASK_PASSAGES}").alias("tasks"))
    tasks = written(tasks, "tasks")
    dealt = passages.join(tasks, "shard").withColumn("task", F.expr("pmod(xxhash64(doc_id, first), tasks)"))
    copied = patterns.join(tasks, "shard").withColumn("task", F.explode(F.expr("sequence(0L, tasks - 1)")))

    def run(key, patterns: pd.DataFrame, passages: pd.DataFrame) -> pd.DataFrame:
        return locate(patterns, passages, window)

    found = (
        copied.groupBy("shard", "task")
        .cogroup(dealt.select("doc_id", "first", "words", "shard", "task").groupBy("shard", "task"))
        .applyInPandas(run, "doc_id long, first int, last int")
    )
    spans = written(found.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("spans")), "spans")
    forget(table, hot, tasks)
    return spans.join(copies, "doc_id", "full_outer")


def covered(n_words: int, spans, window: int = WINDOW) -> np.ndarray:
    """Which words the windows of the spans cover."""
    change = np.zeros(n_words + 1, dtype=np.int64)
    for s in spans if spans is not None else ():
        if s["first"] + window <= n_words:
            change[s["first"]] += 1
            change[min(n_words, s["last"] + window)] -= 1
    return np.cumsum(change[:-1]) > 0


def _kept(text: str | None, spans, copy: bool, window: int) -> tuple[int, int, str]:
    """Words, removed words, and the rest joined by one space."""
    words = words_of(text)
    gone = np.full(len(words), len(words) >= window) if copy else covered(len(words), spans, window)
    rest = [w for w, g in zip(words, gone, strict=True) if not g]
    return len(words), int(gone.sum()), b" ".join(rest).decode("utf-8", "surrogatepass")


def marked(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``__spans`` and ``__copy``: what :func:`repeats` found for each row."""
    found = repeats(docs, window).select(F.col("doc_id").alias("__id"), F.col("spans").alias("__spans"), F.col("copies").alias("__copies"))
    rows = docs.withColumn("__own", F.col("doc_id").cast("long"))
    joined = rows.join(found.hint("merge"), F.col("__own") == F.col("__id"), "left")
    return joined.select(*docs.columns, "__spans", _is_copy("__copies").alias("__copy"))


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for each row of ``docs`` (``doc_id``, ``text``).

    A null or empty text has no words; a text shorter than a window loses none.
    Rows equal in id and text are one document and share its result; rows that
    share an id but not the text are judged together, by the id.  A row without
    id keeps all its words and removes none elsewhere.  An empty table gives no
    rows; other columns are not read.
    """

    @F.pandas_udf("n_words long, n_removed long, kept_sha256 string")
    def run(texts: pd.Series, spans: pd.Series, copy: pd.Series) -> pd.DataFrame:
        rows = [_kept(t, s, c, window) for t, s, c in zip(texts, spans, copy, strict=True)]
        return pd.DataFrame(
            [(n, k, hashlib.sha256(rest.encode("utf-8", "surrogatepass")).hexdigest()) for n, k, rest in rows],
            columns=["n_words", "n_removed", "kept_sha256"],
        )

    own = marked(_ids(docs), window)
    return own.select("doc_id", run("text", "__spans", "__copy").alias("__r")).select("doc_id", "__r.*")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without repeated windows: rows that lose words get the others joined by
    one space, rows that lose all of them go, the rest stay as they are.

    Null and empty texts and rows without id stay; repeated rows are judged like
    in :func:`digests`; an empty table gives no rows.
    """
    return under_plain_names(docs, lambda own: _remove_repeats(own, window))


def _remove_repeats(docs: DataFrame, window: int) -> DataFrame:

    @F.pandas_udf("string")
    def rest(texts: pd.Series, spans: pd.Series, copy: pd.Series) -> pd.Series:
        out = []
        for t, s, c in zip(texts, spans, copy, strict=True):
            n, gone, kept = _kept(t, s, c, window)
            out.append(t if not gone else kept if gone < n else None)
        return pd.Series(out, dtype=object)

    # Else Spark repeats the call below the filter, and each task holds two Python workers, which stay.
    rest = rest.asNondeterministic()
    touched = F.col("__spans").isNotNull() | F.col("__copy")
    own = marked(docs, window).withColumn("__rest", F.when(touched, rest("text", "__spans", "__copy")))
    columns = [F.when(touched, F.col("__rest")).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in docs.columns]
    return own.filter(~touched | F.col("__rest").isNotNull()).select(*columns)
