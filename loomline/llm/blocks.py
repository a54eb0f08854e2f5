"""The corpus as ordered blocks of text, and a skew-free answer to "which of these keys stood earlier?".

A block holds consecutive documents by doc_id, about BLOCK_BYTES together. Block numbers rise with doc_id, so (block,
offset) is a place in the whole corpus and places compare like documents. Blocks are written once to the shared folder;
each pass over the text reads them again.

earlier() answers for keys that blocks send. Keys combine twice before they are shuffled: a block sends a key once, from
its first place, and a task sends it for the first of its blocks alone (Sent, which remembers a bounded number of keys);
later blocks of the task know their answer and send just that. So a passage in a third of all documents costs an entry a
task. Keys travel as packed arrays, a row per block and bucket; the bucket is a hash of the key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import cut, partitions, small_batches

BLOCK_BYTES = 1 << 20
#: Packed key bytes that a bucket should hold.
BUCKET_BYTES = 12 << 20


@dataclass
class Block:
    number: int
    ids: pa.Array
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def _packed(number: int, ids: list[pa.Array], parts: list[np.ndarray], lens: list[np.ndarray]) -> pa.RecordBatch:
    all_ids = pa.concat_arrays(ids)
    text = zstandard.ZstdCompressor(1).compress(np.concatenate(parts).tobytes())
    sizes = np.concatenate(lens)
    one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), one(all_ids), one(pa.array(sizes, pa.int64())), pa.array([int(sizes.sum())], pa.int64()), pa.array([text], pa.binary())],
        ["block", "ids", "lens", "size", "text"],
    )


def text_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, ids, lens, size, text of docs (doc_id, text; null is empty), written to the shared folder."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, parts, lens, size = [], [], [], 0
        for b in batches:
            texts = b.column(1).cast(pa.large_binary()).fill_null(b"")
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1])
            offs = np.concatenate(([0], np.cumsum(sizes)))
            raw = texts.buffers()[2]
            base = int(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset]) if len(texts) else 0
            data = np.frombuffer(raw, np.uint8)[base : base + offs[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
            at = 0
            while at < len(texts):
                end = max(at + 1, int(np.searchsorted(offs, offs[at] + block_bytes - size, "right")) - 1)
                if ids and size + offs[end] - offs[at] > block_bytes:
                    yield _packed(number, ids, parts, lens)
                    number, ids, parts, lens, size = number + 1, [], [], [], 0
                    continue
                ids.append(b.column(0).slice(at, end - at))
                parts.append(data[offs[at] : offs[end]].copy())
                lens.append(sizes[at:end])
                size += int(offs[end] - offs[at])
                at = end
        if ids:
            yield _packed(number, ids, parts, lens)

    schema = f"block long, ids array<{kind}>, lens array<long>, size long, text binary"
    docs = docs.select("doc_id", F.col("text").cast("binary"))
    return cut(docs.repartitionByRange(partitions(docs), "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(of, schema))


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, pa.RecordBatch, int]]:
    """Each block of a batch, with the batch and its row for other columns."""
    for b in batches:
        for i in range(b.num_rows):
            lens = b.column("lens")[i].values.to_numpy(zero_copy_only=False)
            size = int(lens.sum())
            raw = zstandard.ZstdDecompressor().decompress(b.column("text")[i].as_py(), max_output_size=max(1, size))
            ends = np.cumsum(lens)
            yield Block(b.column("block")[i].as_py(), b.column("ids")[i].values, np.frombuffer(raw, np.uint8), ends - lens, ends), b, i


def buckets(blocks: DataFrame, bytes_of_key_a_byte: float) -> int:
    total = blocks.agg(F.sum("size")).first()[0] or 0
    return max(partitions(blocks), int(total * bytes_of_key_a_byte / BUCKET_BYTES) + 1)


def dealt(number: int, n: int, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """keys: a structured array; the low half of field k spreads them over n buckets (anchors have small high halves)."""
    bucket = (keys["k"] & np.uint64(0xFFFFFFFF)) * np.uint64(n) >> np.uint64(32)
    order = np.argsort(bucket, kind="stable")
    keys, bucket = keys[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    parts = [p for p in np.split(keys, cuts) if len(p)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(bucket[np.concatenate(([0], cuts))] if parts else [], pa.int64()), pa.array([number] * len(parts), pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())],
        ["bucket", "block", "keys"],
    )


def digests(keys: np.ndarray, *fields: str) -> list[bytes]:
    """These 64-bit fields of each key, as bytes."""
    raw = np.column_stack([keys[f] for f in fields]).astype("<u8").tobytes()
    width = 8 * len(fields)
    return [raw[i : i + width] for i in range(0, len(raw), width)]


class Sent:
    """The keys that a task has sent so far, as bytes, at most MOST of them: what it forgets is sent again."""

    MOST = 1_000_000

    def __init__(self) -> None:
        self.seen: set[bytes] = set()

    def fresh(self, keys: list[bytes]) -> np.ndarray:
        """Which of these (each once) were not sent before; they count as sent now."""
        new = np.fromiter((k not in self.seen for k in keys), bool, len(keys))
        if len(self.seen) < self.MOST:
            self.seen.update(keys)
        return new


def known(number: int, words: np.ndarray, text: bool = False) -> Iterator[pa.RecordBatch]:
    """Answers that a block has without asking, to travel with the keys: a bucket of their own."""
    if len(words):
        columns = [pa.array([-1 - number], pa.int64()), pa.array([number], pa.int64()), pa.array([words.astype("<u4").tobytes()], pa.binary())]
        names = ["bucket", "block", "keys"]
        yield pa.RecordBatch.from_arrays([*columns, *[pa.array([b""], pa.binary())] * text], [*names, *["text"] * text])


def _known(t: pa.Table) -> pa.Table | None:
    if t.column("bucket")[0].as_py() < 0:
        return pa.table({"block": t.column("block"), "answer": t.column("keys")})
    return None


DEALT = "bucket long, block long, keys binary"


def earlier(entries: DataFrame, dtype: np.dtype, judge: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """entries: DEALT. judge(keys, block) returns an answer word (unsigned 32 bits, 0 for none) for each key of a
    bucket. Returns block, answers (a list of packed words)."""

    def reduce(t: pa.Table) -> pa.Table:
        if (told := _known(t)) is not None:
            return told
        rows = [np.frombuffer(x.as_py(), dtype) for x in t.column("keys")]
        block = np.repeat(t.column("block").to_numpy(), [len(r) for r in rows])
        words = judge(np.concatenate(rows), block)
        got = np.flatnonzero(words)
        order = got[np.argsort(block[got], kind="stable")]
        parts = np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(order) else []
        return pa.table({"block": pa.array([block[p[0]] for p in parts], pa.int64()), "answer": pa.array([words[p].astype("<u4").tobytes() for p in parts], pa.binary())})

    return entries.groupBy("bucket").applyInArrow(reduce, "block long, answer binary").groupBy("block").agg(F.collect_list("answer").alias("answers"))


DEALT_TEXT = f"{DEALT}, text binary"


def dealt_text(number: int, n: int, keys: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """dealt(), with the bytes of each key (one after another in data) in the column text."""
    bucket = (keys["k"] & np.uint64(0xFFFFFFFF)) * np.uint64(n) >> np.uint64(32)
    order = np.argsort(bucket, kind="stable")
    begin = np.cumsum(sizes) - sizes
    raw = data.tobytes()
    texts = [raw[a : a + z] for a, z in zip(begin[order].tolist(), sizes[order].tolist())]
    cuts = [0, *(np.flatnonzero(np.diff(bucket[order])) + 1).tolist(), len(order)] if len(order) else [0]
    spans = list(zip(cuts[:-1], cuts[1:]))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([int(bucket[order[a]]) for a, _ in spans], pa.int64()),
            pa.array([number] * len(spans), pa.int64()),
            pa.array([keys[order[a:z]].tobytes() for a, z in spans], pa.binary()),
            pa.array([b"".join(texts[a:z]) for a, z in spans], pa.binary()),
        ],
        ["bucket", "block", "keys", "text"],
    )


def earlier_text(entries: DataFrame, dtype: np.dtype, judge: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """entries: DEALT_TEXT. judge(keys, block, bytes) returns the blocks and answer words of what a bucket finds. Returns
    block, answers, as earlier() does."""

    def reduce(t: pa.Table) -> pa.Table:
        if (told := _known(t)) is not None:
            return told
        rows = [np.frombuffer(x.as_py(), dtype) for x in t.column("keys")]
        block = np.repeat(t.column("block").to_numpy(), [len(r) for r in rows])
        data = np.frombuffer(b"".join(x.as_py() for x in t.column("text")), np.uint8)
        of, words = judge(np.concatenate(rows), block, data)
        order = np.argsort(of, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else []
        return pa.table({"block": pa.array([of[p[0]] for p in parts], pa.int64()), "answer": pa.array([words[p].astype("<u4").tobytes() for p in parts], pa.binary())})

    return entries.groupBy("bucket").applyInArrow(reduce, "block long, answer binary").groupBy("block").agg(F.collect_list("answer").alias("answers"))


def answers(b: pa.RecordBatch, i: int, column: str) -> np.ndarray:
    got = b.column(column)[i].as_py()
    return np.frombuffer(b"".join(got), "<u4") if got else np.zeros(0, np.uint32)
