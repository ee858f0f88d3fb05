"""Documents in blocks with dictionaries of their own: what has to be known of a word for the whole corpus goes out once a block.

A task turns its texts into blocks of about ``BLOCK`` bytes; a block holds its distinct words once and the documents as numbers
of these words. Distinct words travel to where all blocks' occurrences of a word meet, and what is found there returns to the
blocks. A word is sent once a block, so no word is hot, and blocks are alike in size: only a text longer than a block makes its
block as large as itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shingles import buffers, slices

#: Bytes of text and documents of a block.
BLOCK, ROWS = 16 << 20, 200_000
#: Bytes of a text that are split at a time.
PIECE = 1 << 20


def gather(batches: Iterator[pa.RecordBatch], column: str, limit: int | None = None) -> Iterator[tuple[int, pa.Table]]:
    """(number, rows): the task's rows in blocks, numbered apart from those of all other tasks."""
    limit, number = limit or BLOCK, TaskContext.get().partitionId() << 32
    held, size, rows = [], 0, 0
    for b in batches:
        for c in slices(b, column, limit):
            _, bounds = buffers(c[column])
            n = int(bounds[-1] - bounds[0])
            if held and (size + n > limit or rows + c.num_rows > ROWS):
                yield number, pa.Table.from_batches(held)
                held, size, rows, number = [], 0, 0, number + 1
            held.append(c)
            size, rows = size + n, rows + c.num_rows
    if held:
        yield number, pa.Table.from_batches(held)


def pack(values: np.ndarray) -> bytes:
    """Numbers below 2 ** 32, plane by plane of their bytes, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def unpack(data: bytes, n: int) -> np.ndarray:
    if n == 0:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def first_row(values: list, n: int) -> list:
    """A column with what belongs to the whole block in the block's first row."""
    return values + [None] * (n - 1)


def postings(blocks: DataFrame) -> DataFrame:
    """(block, local, word): every block's distinct words, equal ones together in one partition and in order."""
    rows = blocks.where("words IS NOT NULL").select("block", F.posexplode("words").alias("local", "word"))
    return rows.repartition("word").sortWithinPartitions("word", "block")


def runs(batches: Iterator[pa.RecordBatch], least: int = 65_536) -> Iterator[tuple[pa.Table, pa.Array, np.ndarray, bool]]:
    """(rows, their distinct words in order, each row's place among these, whether the first word goes on from the rows before)."""
    held, size, last = [], 0, None

    def made():
        t = pa.Table.from_batches(held).combine_chunks()
        d = t["word"].combine_chunks().dictionary_encode()
        d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
        return t, d.dictionary, d.indices.to_numpy().astype(np.int64), last is not None and d.dictionary[0].as_py() == last

    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.num_rows
        if size >= least:
            yield (out := made())
            held, size, last = [], 0, out[1][-1].as_py()
    if held:
        yield made()


def returned(blocks: DataFrame, values: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run(documents of a block, values of its words)`` for every block: two tables of bounded size."""
    return blocks.drop("words").groupBy("block").cogroup(values.groupBy("block")).applyInArrow(run, schema)
