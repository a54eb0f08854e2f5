"""Substring dedup by content-defined chunks.

A gear hash of 16 bits rolls over each text's bytes (every byte shifts the hash by one, so it sees the last 16) and a
chunk ends where its top five bits are zero, after 16 bytes at least and 256 at most; a rest of under 16 bytes joins the
chunk before it. Boundaries depend on the bytes around them alone, so that an insertion moves the chunks next to it and
no others. Chunks with equal 128-bit digests are equal; the one that stands first (smaller doc_id, then earlier) is
original. A duplicate is removed where it belongs to a run of neighbouring duplicates of MIN_RUN bytes or more, or one that
is a whole text or whole lines: shorter ones within a line are everyday phrases.

A null text counts as empty; null doc_ids come first in the order. Rows that share a doc_id are ordered by text and
each give a row; of wholly repeated rows one counts as the first. Removal goes by
bytes, so cut characters may remain at a seam; the kept text replaces them. An empty table gives no rows. Columns besides
doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from loomline.llm.blocks import DEALT, Block, Sent, answers, buckets, dealt, digests, earlier, known, opened, text_blocks
from loomline.llm.common import cut, table

MIN_CHUNK, MAX_CHUNK, MASK_BITS, MIN_RUN = 16, 256, 5, 100
NEWLINE = 0x0A
_GEAR = np.random.default_rng(21).integers(0, 1 << 16, 256, np.uint16)
_KEY = np.dtype([("k", "<u8"), ("l", "<u8"), ("at", "<u4")])


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, by doubling the window four times."""
    h = _GEAR[data]
    for s in (1, 2, 4, 8):
        h[s:] = h[s:] + (h[:-s] << np.uint16(s))
    return h


def chunk_bounds(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every chunk, and the document (its place in the block) that it is in."""
    ends_at = np.flatnonzero(gear(block.data) >> np.uint16(16 - MASK_BITS) == 0) + 1
    first = np.searchsorted(ends_at, block.starts, "right")
    last = np.searchsorted(ends_at, block.ends, "left")
    candidates = ends_at.tolist()
    begin, end, doc = [], [], []
    for d, (s, e) in enumerate(zip(block.starts.tolist(), block.ends.tolist())):
        if s == e:
            continue
        pos, cuts = s, [s]
        for c in candidates[first[d] : last[d]] + [e]:
            if c - pos < MIN_CHUNK:
                continue
            while c - pos > MAX_CHUNK:
                pos += MAX_CHUNK
                cuts.append(pos)
            if c - pos >= MIN_CHUNK:
                cuts.append(c)
                pos = c
        if cuts[-1] != e:
            if len(cuts) > 1:
                cuts[-1] = e
            else:
                cuts.append(e)
        begin += cuts[:-1]
        end += cuts[1:]
        doc += [d] * (len(cuts) - 1)
    return np.array(begin, np.int64), np.array(end, np.int64), np.array(doc, np.int64)


def chunk_keys(block: Block, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for every distinct digest, from its first chunk, and which chunks repeat one of this block."""
    raw = block.data.tobytes()
    digest = xxhash.xxh3_128_digest
    words = np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip(begin.tolist(), end.tolist())]), "<u8").reshape(-1, 2)
    order = np.lexsort((np.arange(len(words)), words[:, 1], words[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (words[order[1:]] != words[order[:-1]]).any(1)
    repeats = np.ones(len(words), bool)
    repeats[order[new]] = False
    keys = np.zeros(int(new.sum()), _KEY)
    keys["k"], keys["l"], keys["at"] = words[order[new], 0], words[order[new], 1], order[new]
    return keys, repeats


def _later(keys: np.ndarray, block: np.ndarray) -> np.ndarray:
    """A chunk's place plus one where a lower block has the same digest."""
    order = np.lexsort((block, keys["l"], keys["k"]))
    k = keys[order]
    same = np.zeros(len(k), bool)
    same[1:] = (k["k"][1:] == k["k"][:-1]) & (k["l"][1:] == k["l"][:-1])
    out = np.zeros(len(k), np.uint32)
    out[order[same]] = k["at"][same] + 1
    return out


def removed_runs(block: Block, begin: np.ndarray, end: np.ndarray, doc: np.ndarray, duplicate: np.ndarray, min_run: int) -> list[tuple[int, int, int]]:
    """(document, start, end) of the runs of duplicate chunks to remove: long ones, whole texts and whole lines."""
    d = np.concatenate(([False], duplicate, [False]))
    new_doc = np.concatenate(([True], doc[1:] != doc[:-1], [True])) if len(doc) else np.array([True])
    starts = np.flatnonzero(d[1:-1] & (~d[:-2] | new_doc[:-1]))
    stops = np.flatnonzero(d[1:-1] & (~d[2:] | new_doc[1:]))
    out = []
    for k, a, z in zip(doc[starts].tolist(), begin[starts].tolist(), end[stops].tolist()):
        first, last = int(block.starts[k]), int(block.ends[k])
        opens = a == first or block.data[a - 1] == NEWLINE
        closes = z == last or block.data[z - 1] == NEWLINE or block.data[z] == NEWLINE
        if z - a >= min_run or (opens and closes):
            out.append((k, a, z))
    return out


def report(block: Block, runs: list[tuple[int, int, int]], chunks: np.ndarray | None = None) -> pa.RecordBatch:
    """A row for each document of the block: counts, the digest of what is left, the spans taken out, what is left."""
    per: list[list[tuple[int, int]]] = [[] for _ in block.starts]
    for d, a, z in runs:
        per[d].append((a, z))
    raw = block.data.tobytes()
    columns: dict[str, list] = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text")}
    for s, e, spans in zip(block.starts.tolist(), block.ends.tolist(), per):
        kept, pos = [], s
        for a, z in spans:
            kept.append(raw[pos:a])
            pos = z
        left = b"".join([*kept, raw[pos:e]])
        for name, value in zip(columns, (e - s, e - s - len(left), len(spans), hashlib.sha256(left).hexdigest(), [{"begin": a - s, "end": z - s} for a, z in spans], left.decode("utf-8", "replace"))):
            columns[name].append(value)
    kinds = {"kept_sha256": pa.string(), "spans": pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), "kept_text": pa.string()}
    arrays = [block.ids, *(pa.array(v, kinds.get(n, pa.int64())) for n, v in columns.items())]
    names = ["doc_id", *columns]
    if chunks is not None:
        arrays.append(pa.array(chunks, pa.int64()))
        names.append("n_chunks")
    return pa.RecordBatch.from_arrays(arrays, names)


REPORT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin:long,end:long>>, kept_text string"


def chunk_dedup(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """doc_id, the columns of REPORT, n_chunks: each document without the chunks that stood earlier."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = text_blocks(docs)
    n = buckets(blocks, _KEY.itemsize / 40)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = Sent()
        for block, _, _ in opened(batches):
            begin, end, _ = chunk_bounds(block)
            keys = chunk_keys(block, begin, end)[0]
            new = sent.fresh(digests(keys, "k", "l"))
            yield from dealt(block.number, n, keys[new])
            yield from known(block.number, keys["at"][~new] + np.uint32(1))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, b, i in opened(batches):
            begin, end, doc = chunk_bounds(block)
            _, duplicate = chunk_keys(block, begin, end)
            duplicate[answers(b, i, "answers").astype(np.int64) - 1] = True
            yield report(block, removed_runs(block, begin, end, doc, duplicate, min_run), np.bincount(doc, minlength=len(block.starts)))

    told = cut(earlier(blocks.mapInArrow(send, DEALT), _KEY, _later))
    return blocks.join(told, "block", "left").mapInArrow(settle, f"doc_id {kind}, {REPORT}, n_chunks long")


def op10_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup(table(spark, sf_dir, "documents")).drop("kept_text", "spans")
