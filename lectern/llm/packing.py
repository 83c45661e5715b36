"""Sum-of-squares online packing of token sequences.

Each task packs the documents of its input split as they come. A document's
tokens end with an end-of-document id. Whole windows are cut off a longer
document first; what is left goes to the fill level for which the sum of squared
counts of partly filled windows becomes least (a new window is level 0, a full
one leaves the count). The counts lie in an array by level, and ties go to
the fullest level. When the split ends, the windows still open are packed again by the
same rule, each whole, for as long as that leaves fewer of them. What stays open then is topped up: the fullest
window takes the emptiest one, whole where it fits and cut where it does not, and only the
last of all is cut into sequences whose lengths are powers of two. So nothing is padded.

Sequences never cross tasks, so nothing is shuffled, and a task that is run
again on the same split gives the same sequences.

Nulls: a null text is empty and yields the end id alone; doc_id may be null or
repeated, each row is a document. An empty table gives an empty result. Texts of
any length are tokenised whole. Other columns of the input are not returned.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, tidy
from .tokens import word_tokenizer

WINDOW, END = 2048, 1
#: Documents that are tokenised together.
TOGETHER = 128
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class Packer:
    """Windows of one task. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)  # by level; 0 and window stay 0
        self.open: list[list[list]] = [[] for _ in range(window + 1)]

    def level_for(self, size: int) -> int:
        """The level (0: a new window) that a piece of this size should go to."""
        n, w = self.counts, self.window
        before = n[: w - size + 1]
        after = n[size:]
        change = 2 * after + 1 + np.where(before > 0, 1 - 2 * before, 0)
        change[w - size] -= 1  # that window would be full: nothing is added to a count
        allowed = before > 0
        allowed[0] = True
        change = np.where(allowed, change, np.iinfo(np.int64).max)
        return int(w - size - np.argmin(change[::-1]))

    def put(self, pieces: list, size: int) -> list | None:
        """Place pieces of this size in one window, no longer than it; the window's pieces if that fills it."""
        level = self.level_for(size)
        content = self.open[level].pop() if level else []
        if level:
            self.counts[level] -= 1
        content += pieces
        if level + size == self.window:
            return content
        self.counts[level + size] += 1
        self.open[level + size].append(content)
        return None

    def add(self, piece: tuple) -> list | None:
        return self.put([piece], len(piece[2]))

    def add_document(self, doc_id, ids: np.ndarray) -> Iterator[list]:
        total = len(ids)
        for at in range(0, total, self.window):
            part = ids[at : at + self.window]
            full = self.add((doc_id, at, part.copy() if at else part, total))  # a view would hold the whole document
            if full is not None:
                yield full

    def _take(self) -> list[tuple[int, list]]:
        """All open windows with their sizes, the fullest first; none stays."""
        out = [(level, content) for level in range(self.window, 0, -1) for content in self.open[level]]
        self.counts[:] = 0
        self.open = [[] for _ in range(self.window + 1)]
        return out

    def close(self) -> Iterator[list]:
        """The sequences made of all windows that are still open."""
        before = None
        while before is None or int(self.counts.sum()) < before:
            before = int(self.counts.sum())
            for size, content in self._take():
                full = self.put(content, size)
                if full is not None:
                    yield full
        left = self._take()
        low, high = 0, len(left) - 1
        while low < high:
            (size, content), (other, small) = left[low], left[high]
            head, tail = cut(small, self.window - size)
            joined = size + other - sum(len(p[2]) for p in tail)
            left[low], left[high] = (joined, content + head), (size + other - joined, tail)
            if not tail:
                high -= 1
            if joined == self.window:
                yield left[low][1]
                low += 1
        if low <= high and left:
            size, content = left[low]
            while size:
                room = 1 << (size.bit_length() - 1)
                head, content = cut(content, room)
                yield head
                size -= room


def cut(pieces: list[tuple], room: int) -> tuple[list[tuple], list[tuple]]:
    """Pieces up to so many tokens, and the rest."""
    for k, (doc_id, start, ids, total) in enumerate(pieces):
        if len(ids) > room:
            first = [(doc_id, start, ids[:room], total)] if room else []
            return [*pieces[:k], *first], [(doc_id, start + room, ids[room:], total), *pieces[k + 1:]]
        room -= len(ids)
    return pieces, []


def pack(df: DataFrame, tokenizer: str = "word_bpe_49k.json", window: int = WINDOW, end: int = END) -> DataFrame:
    """One row per piece: where its ids come from, their checksum, and their place in a sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenize, packer = word_tokenizer(tokenizer), Packer(window)
        number = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def put(content: list) -> None:
            nonlocal number
            offset = 0
            for doc_id, start, ids, total in content:
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, number, offset))
                offset += len(ids)
            number += 1

        def taken() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in SCHEMA.split(", ")])

        last = np.array([end], np.uint32)
        for batch in batches:
            for low in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(low, TOGETHER)
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), tokenize(part.column("text")), strict=True):
                    for content in packer.add_document(doc_id, np.concatenate([ids, last])):
                        put(content)
                if len(rows) > 8192:
                    yield taken()
        tokenize.forget()
        for content in packer.close():
            put(content)
        if rows:
            yield taken()

    small_batches(df.sparkSession)
    return df.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(tidy(run), SCHEMA)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
