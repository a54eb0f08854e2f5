"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Words are runs of letters, digits and bytes beyond ASCII, A-Z lower-cased. Every item has its word trigrams as seeds (an
item of fewer words is one seed). A first pass over all documents counts in how many of them each seed occurs. A seed is
rare for its item if that count is at most RARE times that of the item's rarest quarter: the scale comes from the item
itself. A second pass looks the seeds up in every document and aligns the places that they point at with the item, in
batches: match 2, mismatch -1, gap -1, the best local score as a share of that of the whole item. A rare seed's place is
always aligned; that of any other seed (everyday words, or an excerpt that stands in many documents) unless its words
alone show that it can't reach the least score: each word of the item counts 2, any other -1, and no alignment scores
more than the best run of these. No seed is left out.

The items are looked up in blocks of at most BLOCK_CHARS characters, each sent to all tasks: the size of what is
broadcast is bounded, and a larger benchmark takes more passes.

Nulls: a null or wordless text matches nothing, nor does a null or wordless item; null ids are returned as they are.
Repeated documents or items each give their row. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import grams, mix, padded, prefix_hash, random_table, separated, small_batches, table, text_views

SEED_WORDS, RARE, MIN_SCORE, BLOCK_CHARS = 3, 4, 0.5, 8_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
_BASE = 0x9E3779B97F4A7C15
_TABLE = random_table(11)
_BLOCK = 1 << 20
_SLOTS, _PIECE = 1024, 1 << 20

_WORD = np.zeros(256, np.uint8)
for _span, _to in ((range(0x30, 0x3A), 0), (range(0x61, 0x7B), 0), (range(0x41, 0x5B), 0x20), (range(0x80, 0x100), 0)):
    for _b in _span:
        _WORD[_b] = _b + _to


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the text it is in. Texts end in a separator."""
    folded = _WORD[data]
    is_word = np.concatenate(([False], folded > 0, [False]))
    edges = np.flatnonzero(is_word[1:] != is_word[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums, inverse = prefix_hash(folded, _TABLE, _BASE)
    return mix((sums[ends] - sums[starts]) * inverse[starts]), np.searchsorted(offsets, starts, "right") - 1


@dataclass
class Items:
    """A block of benchmark items and where each seed stands in them (sorted by seed)."""

    ids: list
    words: list[np.ndarray]
    seeds: np.ndarray
    item: np.ndarray
    place: np.ndarray
    size: np.ndarray
    rare: np.ndarray

    @classmethod
    def of(cls, ids: list, texts: list[str], seed_words: int = SEED_WORDS) -> Items:
        words = []
        for t in texts:
            data = np.frombuffer(t.encode() + b" ", np.uint8)
            words.append(word_hashes(data, np.array([0, len(data)]))[0])
        rows = []
        for i, w in enumerate(words):
            size = min(seed_words, len(w))
            if size:
                g = grams(w, size)
                rows.append((g, np.full(len(g), i), np.arange(len(g)), np.full(len(g), size)))
        seeds, item, place, size = (np.concatenate(x) for x in zip(*rows)) if rows else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
        order = np.argsort(seeds, kind="stable")
        return cls(ids, words, seeds[order], item[order], place[order], size[order], np.ones(len(order), bool))

    @cached_property
    def holds(self) -> np.ndarray:
        """Of each item, which low bits its words have."""
        out = np.zeros((len(self.words), _SLOTS), bool)
        for i, w in enumerate(self.words):
            out[i, (w % np.uint64(_SLOTS)).astype(np.int64)] = True
        return out

    def lookup(self, words: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word position, distinct seed value's first row) of every seed that occurs inside one text."""
        at, row = [], []
        for size in np.unique(self.size):
            mine = np.flatnonzero(self.size == size)
            values, first = np.unique(self.seeds[mine], return_index=True)
            g = grams(words, int(size))
            maybe = np.zeros(1 << 16, bool)
            maybe[(values >> np.uint64(48)).astype(np.int64)] = True
            i = np.flatnonzero(maybe[(g >> np.uint64(48)).astype(np.int64)])
            i = i[of[i] == of[i + size - 1]]
            k = np.minimum(np.searchsorted(values, g[i]), len(values) - 1)
            hit = values[k] == g[i]
            at.append(i[hit])
            row.append(mine[first[k[hit]]])
        return (np.concatenate(at), np.concatenate(row)) if at else (np.zeros(0, np.int64),) * 2


def smith_waterman(items: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Best local score of each row of items with the same row of windows (word hashes; padding matches nothing)."""
    rows, n = windows.shape
    steps = np.arange(1, n + 1, dtype=np.int32) * -GAP
    prev, best = np.zeros((rows, n + 1), np.int32), np.zeros(rows, np.int32)
    for i in range(items.shape[1]):
        now = np.maximum(prev[:, :-1] + np.where(items[:, i, None] == windows, MATCH, MISMATCH), prev[:, 1:] + GAP)
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + steps, axis=1) - steps
        np.maximum(best, now.max(1, initial=0), out=best)
        prev[:, 1:] = now
    return best


def most(items: Items, item: np.ndarray, words: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A score that no alignment of each item with words[lo:hi] exceeds."""
    out = np.zeros(len(item), np.int64)
    order = np.argsort(hi - lo, kind="stable")
    at = 0
    while at < len(order):
        k = order[at : at + 4096]
        k = k[: max(1, _PIECE // max(1, int((hi[k] - lo[k]).max())))]
        at += len(k)
        width = int((hi[k] - lo[k]).max())
        if width > 0:
            pos = lo[k, None] + np.arange(width)
            slot = (words[np.minimum(pos, len(words) - 1)] % np.uint64(_SLOTS)).astype(np.int64)
            gain = np.where(items.holds[item[k, None], slot] & (pos < hi[k, None]), MATCH, GAP)
            run = np.concatenate((np.zeros((len(k), 1), np.int64), np.cumsum(gain, axis=1)), axis=1)
            out[k] = (run - np.minimum.accumulate(run, axis=1)).max(1)
    return out


def align(items: Items, words: np.ndarray, of: np.ndarray, min_score: float = MIN_SCORE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, share of the item's score) of every pair that a seed points at, best place each; 0 where all places
    are sure to be below min_score."""
    found, found_row = items.lookup(words, of)
    if not len(found):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    lengths = np.array([len(w) for w in items.words])
    times = np.searchsorted(items.seeds, items.seeds[found_row], "right") - found_row
    done, parts, start = np.cumsum(times), [], 0
    while start < len(found):
        end = max(start + 1, int(np.searchsorted(done, done[start] - times[start] + _PIECE, "right")))
        n = times[start:end]
        at = np.repeat(found[start:end], n)
        row = np.repeat(found_row[start:end], n) + (np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n))
        pad = lengths[items.item[row]] // 2 + 2
        parts.append(np.unique(np.column_stack([of[at], items.item[row], (at - items.place[row]) // pad * pad - pad, ~items.rare[row]]), axis=0))
        start = end
    spots = np.unique(np.concatenate(parts), axis=0)  # a place's rare seeds stand before its others
    spots = spots[np.concatenate(([True], (spots[1:, :3] != spots[:-1, :3]).any(1)))]
    first, last = np.searchsorted(of, spots[:, 0], "left"), np.searchsorted(of, spots[:, 0], "right")
    m = lengths[spots[:, 1]]
    lo = np.maximum(first, spots[:, 2])
    hi = np.minimum(last, spots[:, 2] + m + 3 * (m // 2 + 2))
    open_ = spots[:, 3] == 0
    k = np.flatnonzero(~open_)
    open_[k] = most(items, spots[k, 1], words, lo[k], hi[k]) >= min_score * MATCH * m[k] - 1e-6
    share = np.zeros(len(spots))
    order = np.flatnonzero(open_)
    order = order[np.argsort(m[order], kind="stable")]
    at = 0
    while at < len(order):
        widest = int(m[order[at : at + 256]].max())
        k = order[at : at + max(1, min(256, 4_000_000 // max(1, widest * 3)))]
        width = int((hi[k] - lo[k]).max())
        if width > 0:
            pos = lo[k, None] + np.arange(width)
            windows = np.where(pos < hi[k, None], words[np.minimum(pos, len(words) - 1)], np.uint64(1))
            whole = np.zeros((len(k), int(m[k].max())), np.uint64)
            for r, i in enumerate(spots[k, 1]):
                whole[r, : m[k[r]]] = items.words[i]
            share[k] = smith_waterman(whole, windows) / (MATCH * m[k])
        at += len(k)
    pairs, inverse = np.unique(spots[:, :2], axis=0, return_inverse=True)
    best = np.zeros(len(pairs))
    np.maximum.at(best, inverse.ravel(), share)
    return pairs[:, 0], pairs[:, 1], best


def item_blocks(benchmark: DataFrame, limit: int = BLOCK_CHARS) -> Iterator[Items]:
    """The benchmark in blocks of bounded size."""
    ids, texts, size = [], [], 0
    for r in benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).toLocalIterator():
        if texts and size + len(r.text) > limit:
            yield Items.of(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        size += len(r.text)
    if texts:
        yield Items.of(ids, texts)


def rare_seeds(docs: DataFrame, items: Items, rare: int = RARE) -> Items:
    """The items, with their seeds that are rare over all documents marked."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(items.seeds), np.int64)
        for b in batches:
            for _, _, data, offsets in text_views(b, "text", _BLOCK):
                words, of = word_hashes(data, offsets)
                at, row = items.lookup(words, of)
                pairs = np.unique(np.column_stack([row, of[at]]), axis=0)
                found += np.bincount(pairs[:, 0], minlength=len(found))
        row = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(found[row])], ["row", "n"])

    total = docs.select(separated("text")).mapInArrow(count, "row long, n long").groupBy("row").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(len(items.seeds), np.int64)
    df[total.row] = total.n
    df = df[np.searchsorted(items.seeds, items.seeds, "left")]  # counted at the first row of each value
    few = np.zeros(len(df), bool)
    order = np.argsort(items.item, kind="stable")
    for mine in np.split(order, np.flatnonzero(np.diff(items.item[order])) + 1):
        few[mine] = df[mine] <= rare * max(1, np.quantile(df[mine], 0.25, method="lower"))
    return replace(items, rare=few)


def contaminated(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, item_id, score for each document and item that align at min_score or more."""
    spark = docs.sparkSession
    small_batches(spark)
    kind, item_kind = (x.schema[c].dataType.simpleString() for x, c in ((docs, "doc_id"), (benchmark, "item_id")))
    schema = f"doc_id {kind}, item_id {item_kind}, score double"
    item_type = pa.from_numpy_dtype(np.int64) if item_kind == "bigint" else None
    found = spark.createDataFrame([], schema)
    for block in item_blocks(benchmark):
        items = rare_seeds(docs, block)

        def of(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for start, _, data, offsets in text_views(b, "text", _BLOCK):
                    text, item, score = align(items, *word_hashes(data, offsets), min_score)
                    ok = score >= min_score
                    ids = b.column(0).take(pa.array(start + text[ok], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([items.ids[i] for i in item[ok]], item_type), pa.array(score[ok])], ["doc_id", "item_id", "score"])

        found = found.unionByName(docs.select("doc_id", separated("text")).mapInArrow(of, schema))
    return found


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; each row by its own text, judged and dropped where it is read."""
    small_batches(spark)
    columns = docs.columns
    for block in item_blocks(table(spark, sf_dir, "benchmark")):
        items = rare_seeds(docs, block)

        def clean(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for b in batches:
                stays = np.ones(b.num_rows, bool)
                for start, _, data, offsets in text_views(padded(b, "text", "", " "), "text", _BLOCK):
                    text, _, score = align(items, *word_hashes(data, offsets))
                    stays[start + text[score >= MIN_SCORE]] = False
                yield b.select(columns).filter(pa.array(stays))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
