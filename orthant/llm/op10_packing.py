"""Packing: token sequences of near-equal size by multiway Karmarkar-Karp differencing.

A document's tokens fill whole windows as far as they go. What is left over is
cut into parts of at most PART tokens, and each block of parts is dealt to
windows by differencing: the two partial partitions with the largest
imbalances are merged, the fullest windows of one with the emptiest of the
other, until one partition is left. If a window then exceeds the capacity, one
more window is used and the block is dealt anew.

A sequence has as many tokens as its pieces; a reader pads it to WINDOW, except
where it is a power of two, which can be used as it is. Differencing makes the
windows of a block near-equal, so what padding there is lies in all of them
alike, and in the last block of a task.
"""

from __future__ import annotations

import heapq
import json
from functools import cached_property, lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROWS, small_batches, table
from .segment import IdMemo, pieces, unsure
from .textvec import code_points

WINDOW = 1024
#: Largest part of a cut remainder, and parts dealt at once. Smaller parts and larger blocks leave less padding and take longer.
PART, BLOCK = 256, 4096
END = 0
#: Pieces remembered by a worker; beyond that it forgets all and goes on, with the same results.
MEMO = 250_000


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts as the tokenizers library gives them for a byte-level vocabulary file.

    Texts are split in bulk and each distinct piece is merged once. Texts with
    special tokens, or with characters of uncertain class, go through the
    library itself.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        self.path = path
        spec = json.load(open(path, encoding="utf-8"))
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        alphabet = byte_alphabet()
        self.specials = [t["content"] for t in spec["added_tokens"]]
        merged = [vocab[a + b] for a, b in (m if isinstance(m, list) else m.split(" ") for m in merges)]
        self.core = None
        if all(x < y for x, y in zip(merged, merged[1:], strict=False)):  # merges in order of ids, as ranks need it
            ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items() if all(c in alphabet for c in t)}
            self.core = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.memo = IdMemo(self._find, MEMO)

    @cached_property
    def library(self):
        """The library's own tokenizer, loaded by the first text that needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _find(self, texts: list[str]) -> list[list[int]]:
        if self.core is None:
            return [self.library.encode(t, add_special_tokens=False).ids for t in texts]
        return [self.core._core_bpe.encode_single_piece(t.encode()) for t in texts]

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text (null: none)."""
        points, offsets = code_points(texts)
        odd = unsure(points, offsets)
        for i, t in enumerate(texts):
            if t and any(s in t for s in self.specials):
                odd[i] = True
        starts, ends = pieces(points, offsets, spaces=True)
        flat, total = self.memo(points, starts, ends)
        cut = total[np.searchsorted(starts, offsets)]
        out = [flat[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        for i in np.flatnonzero(odd):
            out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.int32)
        return out


@lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def difference(sizes: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """Window of each item and window sums, by multiway Karmarkar-Karp differencing.

    A partial partition is a descending vector of window sums, less their
    minimum, with the list of items behind each; its imbalance is the first
    sum. A single item is one too. While the next items are all more
    imbalanced than any vector, merging them one by one only lines them up, so
    that is done at once for up to a vector's length.
    """
    n = len(sizes)
    order = np.argsort(-sizes, kind="stable")
    falling = -sizes[order]
    after, tail = np.full(n, -1), np.arange(n)  # items of a window as linked lists named by their first item
    heap: list[tuple] = []
    made = at = 0

    def line_up(most: int) -> tuple[np.ndarray, np.ndarray]:
        nonlocal at
        sums, heads = np.zeros(windows, np.int64), np.full(windows, -1)
        taken = order[at : at + most]
        sums[: len(taken)], heads[: len(taken)] = sizes[taken], taken
        at += len(taken)
        return sums, heads

    def push(sums: np.ndarray, heads: np.ndarray) -> None:
        nonlocal made
        sums = sums - sums[-1]
        heapq.heappush(heap, (-int(sums[0]), made, sums, heads))
        made += 1

    while at < n or len(heap) > 1:
        above = heap[0][0] if heap else 1  # minus the largest imbalance of a vector
        count = int(np.searchsorted(falling, above, "left")) - at
        if count > 0:
            push(*line_up(min(count, windows)))
            continue
        _, _, a, ha = heapq.heappop(heap)
        if at < n and (not heap or falling[at] <= heap[0][0]):
            b, hb = line_up(1)
        else:
            _, _, b, hb = heapq.heappop(heap)
        sums, hb = a + b[::-1], hb[::-1]
        both = (ha >= 0) & (hb >= 0)
        after[tail[ha[both]]] = hb[both]
        tail[ha[both]] = tail[hb[both]]
        heads = np.where(ha >= 0, ha, hb)
        by = np.argsort(-sums, kind="stable")
        push(sums[by], heads[by])
    window, total = np.empty(n, np.int64), np.zeros(windows, np.int64)
    for w, i in enumerate(heap[0][3].tolist() if heap else []):
        while i >= 0:
            window[i] = w
            total[w] += sizes[i]
            i = after[i]
    return window, total


def deal(sizes: np.ndarray, capacity: int = WINDOW) -> np.ndarray:
    """Window of each item such that none holds more than the capacity; the number of windows rises until that is so."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window, total = difference(sizes, windows)
        if total.max(initial=0) <= capacity:
            return window
        windows += 1


_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Needs no shuffle: each task packs what it reads, so one sequence of a
    task's last block may be padded more. A lost task is done again with the
    same ids. Null and empty texts consist of the end id alone. Equal rows are
    packed each; a null doc_id stays null; other columns are not read.
    """
    small_batches(docs)
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches):
        base, count, encode = TaskContext.get().partitionId() << 32, 0, encoder(path)
        held: list[tuple] = []

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=list(names))

        def flush() -> list[tuple]:
            nonlocal held, count
            window = deal(np.array([x[2] for x in held], np.int64))
            at: dict[int, int] = {}
            rows = []
            for w, (doc, start, length, ids, n) in zip(window.tolist(), held, strict=True):
                rows.append((doc, start, length, ids, n, base + count + w, at.get(w, 0)))
                at[w] = at.get(w, 0) + length
            count += int(window.max()) + 1
            held = []
            return rows

        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            names, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= 1 << 20):
                    size += len(texts[hi] or "")
                    hi += 1
                rows = []
                for doc, ids in zip(names[lo:hi], encode(texts[lo:hi]), strict=True):
                    ids = np.append(ids, np.uint32(END)).astype("<u4")
                    n, whole = len(ids), len(ids) // WINDOW * WINDOW
                    for start in range(0, whole, WINDOW):
                        rows.append((doc, start, WINDOW, ids[start : start + WINDOW].tobytes(), n, base + count, 0))
                        count += 1
                    for start in range(whole, n, PART):
                        part = ids[start : start + PART]
                        held.append((doc, start, len(part), part.tobytes(), n))
                        if len(held) == BLOCK:
                            rows += flush()
                if rows:
                    yield emit(rows)
                lo = hi
        if held:
            yield emit(flush())

    return docs.select("doc_id", "text").mapInArrow(run, _SCHEMA)


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents; returns their pieces with ids."""
    return pack(docs)
