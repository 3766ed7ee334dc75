"""Packing of token sequences into fixed windows with the sum-of-squares rule for online bin packing.

A document longer than a window is cut into full windows and one rest.  Rests go, in blocks of bounded size, through the
online packer: it keeps an array that counts the open windows by their fill level, and puts a piece where the sum of the
squared counts of partially filled windows becomes least; so no fill level piles up, and windows end up full.  The few
windows that are open when a block ends are put together.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written
from .tokens import with_end, worker_encoder

BROADCAST_NAMES = 100_000


class SumOfSquares:
    """The online packer of one block.  levels[l]: windows filled to l; stacks[l]: which ones; fills: each window's level."""

    def __init__(self, window: int):
        self.window, self.levels = window, np.zeros(window + 1, np.int64)
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]
        self.fills: list[int] = []

    def whole(self) -> int:
        """A window that one piece fills."""
        self.fills.append(self.window)
        return len(self.fills) - 1

    def place(self, length: int) -> tuple[int, int]:
        """(window, offset) of a piece shorter than a window."""
        w, n = self.window, self.levels
        # Moving a window from level l to l + length changes the sum by 2 (n[l + length] - n[l]) + 2; a full window no
        # longer counts (-2 n[l] + 1), and a new one changes it by 2 n[length] + 1.
        change = 2 * (n[length:] - n[: w + 1 - length]) + 2
        change[-1] = 1 - 2 * n[w - length]
        change[0] = 2 * n[length] + 1
        change[1:][n[1 : w + 1 - length] == 0] = 1 << 60
        level = w - length - int(change[::-1].argmin())  # ties: the fullest
        if level:
            at = self.stacks[level].pop()
            n[level] -= 1
        else:
            at = self.whole()
        self.fills[at] = level + length
        if level + length < w:
            n[level + length] += 1
            self.stacks[level + length].append(at)
        return at, level

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        """For each window its final number, gapless, and how far its pieces move: windows still open at the end are put
        together, the fullest first, each with the fullest others that fit."""
        fills = np.array(self.fills, np.int64)
        into, shift = np.arange(len(fills)), np.zeros(len(fills), np.int64)
        open_at = {level: list(stack) for level, stack in enumerate(self.stacks) if stack}
        levels = sorted(open_at)
        while levels:
            base = open_at[levels[-1]].pop()
            held = levels[-1]
            if not open_at[levels[-1]]:
                levels.pop()
            while (i := bisect.bisect_right(levels, self.window - held)) > 0:
                level = levels[i - 1]
                other = open_at[level].pop()
                if not open_at[level]:
                    levels.pop(i - 1)
                into[other], shift[other] = base, held
                held += level
        number = np.cumsum(into == np.arange(len(fills))) - 1
        return number[into], shift


def tokenize(docs: DataFrame, path: str, *, end: int, window: int, id_col: str, text_col: str) -> DataFrame:
    """(id, doc_tokens, crcs, row): tokens of every whole text with its end id, the CRC-32 of each piece of `window` ids, and a running number within the task."""
    schema = "id bigint, doc_tokens bigint, crcs array<bigint>, row bigint"

    def run(batches):
        encoder, row = worker_encoder(path), 0
        for part in slices(batches, "text", 1 << 19):
            offsets, ids = with_end(*encoder.encode(part.column(1).to_pylist()), end)
            data = memoryview(ids.astype("<u4").tobytes())
            sizes = np.diff(offsets)
            crcs = [[zlib.crc32(data[4 * s : 4 * min(s + window, b)]) for s in range(a, b, window)] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(np.arange(row, row + part.num_rows))], names=["id", "doc_tokens", "crcs", "row"])
            row += part.num_rows

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, *, end: int = 0, window: int = 1024, block_rows: int = 32_768, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Blocks hold block_rows documents or so, dealt by a hash of id and tokens and packed each by itself, so their number
    grows with the rows, however often one of them repeats; sequence_id is block * 2^32 + the window's number in its block.  A null or empty text has the end
    id alone; repeated rows are documents of their own; an empty table gives no piece; other columns are not read.
    """
    rows = tokenize(docs, path, end=end, window=window, id_col=id_col, text_col=text_col)
    blocks = max(1, -(-docs.count() // block_rows))
    rows = written(rows, "pieces")
    name = F.xxhash64("id", "doc_tokens", F.element_at("crcs", -1))
    # Rows that repeat more often than a block should hold are dealt by their number; which of equal rows goes where changes nothing.
    hot = written(rows.groupBy(name.alias("name")).count().where(F.col("count") > max(1, block_rows // 8)).select("name", F.lit(True).alias("hot")), "hot")  # rows / 4096 at most
    rows = rows.withColumn("name", name).join(F.broadcast(hot) if hot.count() <= BROADCAST_NAMES else hot, "name", "left")
    dealt = rows.withColumn("block", F.pmod(F.when(F.col("hot"), F.xxhash64("name", "row")).otherwise(F.col("name")), F.lit(blocks)).cast("int")).select("id", "doc_tokens", "crcs", "block")
    dealt = dealt.repartitionById(blocks, "block").sortWithinPartitions("block", "id", "doc_tokens", "crcs")
    schema = f"`{id_col}` bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

    def run(batches):
        packer, block, out = None, -1, []

        def packed():
            number, shift = packer.close()
            columns = [np.array(c, object if k == 0 else np.int64) for k, c in enumerate(zip(*out, strict=True))]
            columns[5], columns[6] = (block << 32) + number[columns[5]], columns[6] + shift[columns[5]]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for part in batches:
            for doc, tokens, crcs, own in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if own != block:
                    if out:
                        yield packed()
                    packer, block, out = SumOfSquares(window), own, []
                for k, crc in enumerate(crcs):
                    length = min(window, tokens - k * window)
                    at, offset = (packer.whole(), 0) if length == window else packer.place(length)
                    out.append((doc, k * window, length, crc, tokens, at, offset))
        if out:
            yield packed()

    return dealt.mapInArrow(run, schema)
