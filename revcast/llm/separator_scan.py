"""Token counts by scanning flat token files for end-of-document identifiers.

A flat file holds little-endian unsigned numbers of one width and nothing else:
no header, no index, and document boundaries only where the end identifier
stands.  ``count_tokens`` cuts every file into blocks, searches each block with
one vectorised comparison, and stitches the documents that span blocks with a
prefix scan over the blocks' summaries (the running maximum of the last end
before a block and the running number of ends).  The scan has two levels, so
that one file of any size is not summed in one task.

``write_flat`` makes such files: each Spark task appends its documents' ids to
a file of its own through Spark's writer, so they can lie in any store that
Spark writes to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revcast.llm.byte_bpe import tokenizer_of

#: Bytes of a block, bytes for a task, and blocks that one window of the scan covers.
BLOCK_BYTES, TASK_BYTES, SCAN_BLOCKS = 4 << 20, 32 << 20, 4096
#: In the files of ``write_flat`` 0 ends a document, and an id i stands as i + 1.
END = 0


def write_flat(docs: DataFrame, tokenizer_file: str, path: str) -> None:
    """Append the ids of every text of ``docs`` to flat files of 16-bit numbers in ``path``.

    A null or empty text is a document without tokens.  The vocabulary may have
    65,535 ids at most.
    """

    @F.pandas_udf("binary")
    def flat(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = tokenizer_of(tokenizer_file)
        for part in texts:
            found = []
            for text in part:
                ids = np.frombuffer(tokenizer.encode(text), dtype="<u4") + 1
                if len(ids) and ids.max() > 0xFFFF:
                    raise ValueError("an id does not fit into 16 bits")
                found.append(ids.astype("<u2").tobytes())
            yield pd.Series(found)

    # Spark's text writer puts the separator, here the end identifier, behind each value.
    docs.select(flat("text").cast("string").alias("value")).write.option("lineSep", "\0\0").text(path)


def _open(path: str):
    uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
    system, name = pafs.FileSystem.from_uri(uri)
    return system.open_input_file(name)


def scan_blocks(spark: SparkSession, path: str, end_id: int = END, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block: where its ends are, as token positions in the file.

    ``file, block, size, first_end, last_end, n_ends, inner_start, inner_n`` - the latter hold start
    and token count of the documents between two ends of the block.
    Ends are null in a block without one.  A file whose size is no multiple of
    the width is refused.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    step = block_bytes // width * width
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    blocks = files.select(
        F.col("path").alias("file"), "length", F.explode(F.sequence(F.lit(0), F.expr(f"(length - 1) div {step}"))).alias("block")
    ).repartition(max(1, -(-total // TASK_BYTES)), "file", "block")
    kind = np.dtype(f"<u{width}")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, length, block in zip(b.file, b.length, b.block, strict=True):
                if length % width:
                    raise ValueError(f"{file}: {length} bytes are not a whole number of tokens")
                start = block * step
                with _open(file) as f:
                    tokens = np.frombuffer(f.read_at(min(step, length - start), start), dtype=kind)
                ends = np.flatnonzero(tokens == end_id) + start // width
                some = len(ends) > 0
                yield pd.DataFrame(
                    {
                        "file": [file],
                        "block": [block],
                        "size": [length // width],
                        "first_end": pd.array([int(ends[0]) if some else None], dtype="Int64"),
                        "last_end": pd.array([int(ends[-1]) if some else None], dtype="Int64"),
                        "n_ends": [len(ends)],
                        "inner_start": [ends[:-1] + 1],
                        "inner_n": [np.diff(ends) - 1],
                    }
                )

    return blocks.mapInPandas(
        search, "file string, block long, size long, first_end long, last_end long, n_ends long, inner_start array<long>, inner_n array<long>"
    )


def count_tokens(spark: SparkSession, path: str, end_id: int = END, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``file, doc_index, start, n_tokens, complete``: one row per document of the flat files.

    ``doc_index`` counts from 0 in the file's order, ``start`` is the position of
    the document's first token, the end identifier is not counted.  Tokens behind
    a file's last end are a document that is not ``complete``.  Two neighbouring
    ends enclose a document of 0 tokens.  Empty files have no documents.
    """
    blocks = scan_blocks(spark, path, end_id, width, block_bytes).withColumn("part", F.expr(f"block div {SCAN_BLOCKS}"))
    ahead = (Window.unboundedPreceding, -1)
    in_part = Window.partitionBy("file", "part").orderBy("block").rowsBetween(*ahead)
    over_parts = Window.partitionBy("file").orderBy("part").rowsBetween(*ahead)
    parts = (
        blocks.groupBy("file", "part")
        .agg(F.max("last_end").alias("p_last"), F.sum("n_ends").alias("p_ends"))
        .select(
            "file",
            "part",
            F.max("p_last").over(over_parts).alias("p_last"),
            F.coalesce(F.sum("p_ends").over(over_parts), F.lit(0)).alias("p_ends"),
            F.lead("part").over(Window.partitionBy("file").orderBy("part")).isNull().alias("last_part"),
        )
    )
    placed = (
        blocks.select(
            "*",
            F.max("last_end").over(in_part).alias("b_last"),
            F.coalesce(F.sum("n_ends").over(in_part), F.lit(0)).alias("b_ends"),
            F.lead("block").over(Window.partitionBy("file", "part").orderBy("block")).isNull().alias("last_block"),
        )
        .join(parts, ["file", "part"])
        .select(
            "file",
            "size",
            "first_end",
            "inner_start",
            "inner_n",
            "n_ends",
            (F.coalesce("b_last", "p_last", F.lit(-1)) + 1).alias("begin"),
            (F.col("b_ends") + F.col("p_ends")).alias("index"),
            F.coalesce("last_end", "b_last", "p_last", F.lit(-1)).alias("seen"),
            (F.col("last_block") & F.col("last_part")).alias("closes"),
        )
    )
    row = "named_struct('i', {}, 'start', {}, 'n', {}, 'complete', {})"
    first = row.format("index", "begin", "first_end - begin", "true")
    inner = f"transform(inner_n, (n, k) -> {row.format('index + 1 + k', 'inner_start[k]', 'n', 'true')})"
    rest = row.format("index + n_ends", "seen + 1", "size - seen - 1", "false")
    docs = F.expr(
        f"""concat(if(n_ends > 0, array({first}), array()), {inner},
                   if(closes AND size - seen - 1 > 0, array({rest}), array()))"""
    )
    found = placed.select("file", F.explode(docs).alias("d"))
    return found.select(
        "file", F.col("d.i").alias("doc_index"), F.col("d.start").alias("start"), F.col("d.n").alias("n_tokens"), F.col("d.complete").alias("complete")
    )
