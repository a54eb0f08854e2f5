"""Suffix-array dedup: longest-previous-factor of every position, cut at WINDOW bytes.

A byte goes if a WINDOW-byte string that covers it also starts earlier: position i starts such a string exactly if its
longest previous factor is WINDOW or more. In a suffix array (ties by place in the corpus) the longest previous factor of a
suffix is the longer of its common prefixes with the suffix of the previous smaller and of the next smaller place. Cut at
WINDOW bytes, suffixes that agree so far stand in a run, in the order of their places, so within a run the previous
smaller place is the neighbour before, no smaller place follows, and the first of a run has no factor of WINDOW bytes.

A suffix array of the whole corpus would move every byte many times; only suffixes for which the answer is open are sorted:

1. Anchors. Of every WINDOW bytes the 44-byte string of smallest hash is an anchor (winnowing), so equal windows have
   equal anchors at equal distance. An anchor is sent with the hash of all the bytes that windows around it can reach
   (its context, 128 bits with the anchor's). Answers: the same context stood earlier - all windows around the anchor
   repeat; else, if it is the anchor's only context, none does; else they stay open (the edges of a repeated passage, its
   first place included).
2. Suffix order. Of each anchor with open windows the stretch of bytes that these cover goes to the bucket of its hash.
   A bucket builds the suffix array of its stretches by prefix doubling over the bytes themselves, cut at WINDOW, and reads
   the previous and next smaller places off it.
3. The union of repeating windows is taken out of each document.

The first step gets a key once per task, the second once per block (blocks.py), at most CONTEXTS contexts of an anchor and
block (the windows of further ones stay open, and step 2 settles them exactly), so a passage that a block repeats costs no
more than one copy.

A null text counts as empty; null doc_ids come first in the order. Rows that share a doc_id are ordered by text; of
wholly repeated rows one counts as the first. Removal goes by bytes; the kept text replaces cut characters. Very long
texts stand in a block of their own. An empty table gives no rows. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomline.llm.blocks import DEALT, DEALT_TEXT, Block, Sent, answers, buckets, dealt, dealt_text, digests, earlier, earlier_text, known, opened, text_blocks
from loomline.llm.chunk_dedup import REPORT, report
from loomline.llm.common import cut, mix, prefix_hash, random_table, table

WINDOW, GRAM, CONTEXTS = 100, 44, 4
#: Bytes that a byte of stretches weighs in its bucket: ranks and their sorting take that many times as much.
STRETCHED = 3
_BASE = 0xD1342543DE82EF95
_TABLE = random_table(31)
_ANCHOR = np.dtype([("k", "<u8"), ("c", "<u8"), ("at", "<u4")])
#: An anchor's stretch: the anchor's hash, the first open window's place, how many windows. Their bytes follow the keys.
_OPEN = np.dtype([("k", "<u8"), ("at", "<u4"), ("n", "<u4")])
_REPEATS, _OPEN_EDGE = 0, 1
_FAR = np.uint32(0xFFFFFFFF)


def _sliding(x: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """f over x[i : i + width], for every i that has so many."""
    have = 1
    while have * 2 <= width:
        x = f(x[:-have], x[have:])
        have *= 2
    return f(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


class Anchors:
    """What one block's text says: its anchors in place order, their hashes and contexts, and its windows."""

    def __init__(self, block: Block, window: int = WINDOW, gram: int = GRAM):
        self.block, self.window, self.gram = block, window, gram
        n = len(block.data)
        self.reach = window - gram
        lens = block.ends - block.starts
        self.sums, self.inverse = prefix_hash(block.data, _TABLE, _BASE)
        self.valid = np.zeros(max(0, n - window + 1), bool)
        for s, e in zip(block.starts[lens >= window].tolist(), block.ends[lens >= window].tolist()):
            self.valid[s : e - window + 1] = True
        self.least = np.zeros(0, np.uint64)
        self.at = self.index = np.zeros(0, np.int64)
        if not self.valid.any():
            self.hash = self.context = np.zeros(0, np.uint64)
            self.left = self.right = self.at
            return
        grams = self.sums[gram:] - self.sums[:-gram]
        grams *= self.inverse[: n - gram + 1]
        grams = mix(grams)
        key = (grams >> np.uint64(32)).astype(np.uint32)
        for e in block.ends[:-1].tolist():
            key[max(0, e - gram + 1) : e] = _FAR
        # the smallest hash of each window, the first of equals: hash above, place below
        ranked = key.astype(np.uint64)
        ranked <<= np.uint64(32)
        ranked |= np.arange(len(key), dtype=np.uint64)
        self.least = _sliding(ranked, self.reach + 1, np.minimum)
        del ranked, key
        chosen = np.zeros(len(grams), bool)
        chosen[(self.least[self.valid] & np.uint64(_FAR)).astype(np.int64)] = True
        self.at = np.flatnonzero(chosen)
        self.index = np.cumsum(chosen, dtype=np.int32) - 1
        doc = np.searchsorted(block.ends, self.at, "right")
        self.left = np.minimum(self.reach, self.at - block.starts[doc])
        self.right = np.minimum(window, block.ends[doc] - self.at)
        self.hash = grams[self.at]
        a = self.at - self.left
        spread = (self.left * (window + 1) + self.right).astype(np.uint64)
        self.context = mix(mix((self.sums[self.at + self.right] - self.sums[a]) * self.inverse[a]) + spread)

    def classes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the anchors: which are the first of their context here, which of these are sent (the first CONTEXTS of a
        hash), and which repeat a context of this block."""
        first = np.zeros(len(self.at), bool)
        order = np.lexsort((self.at, self.context, self.hash))
        h, c = self.hash[order], self.context[order]
        new = np.ones(len(order), bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        first[order[new]] = True
        mine = np.flatnonzero(first)
        order = mine[np.lexsort((self.at[mine], self.hash[mine]))]
        h = self.hash[order]
        start = np.ones(len(order), bool)
        start[1:] = h[1:] != h[:-1]
        place = np.arange(len(order)) - np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
        sent = np.zeros(len(self.at), bool)
        sent[order[place < CONTEXTS]] = True
        return first, sent, ~first

    def keys(self) -> np.ndarray:
        sent = self.classes()[1]
        out = np.zeros(int(sent.sum()), _ANCHOR)
        out["k"], out["c"], out["at"] = self.hash[sent], self.context[sent], self.at[sent]
        return out

    def settle(self, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """told: answers about sent anchors. Marks of windows that repeat, and of windows that stay open."""
        first, sent, repeats = self.classes()
        state = np.full(len(self.at), -1, np.int8)
        state[repeats] = _REPEATS
        state[first & ~sent] = _OPEN_EDGE
        where = np.searchsorted(self.at, told >> np.uint32(1))
        state[where] = (told & np.uint32(1)).astype(np.int8)
        settled = self._around(state == _REPEATS) & self.valid
        open_ = np.zeros(len(self.valid), bool)
        i = np.flatnonzero(self.valid & ~settled)
        # an equal window has this window's own anchor, so that anchor decides if none stood earlier
        own = self.index[(self.least[i] & np.uint64(_FAR)).astype(np.int64)]
        open_[i[state[own] != -1]] = True
        return settled, open_

    def _around(self, which: np.ndarray) -> np.ndarray:
        """Marks of the windows in which one of these anchors lies."""
        marks = np.zeros(len(self.valid) + 1, np.int32)
        np.add.at(marks, np.maximum(0, self.at[which] - self.reach), 1)
        np.add.at(marks, np.minimum(len(self.valid), self.at[which] + 1), -1)
        return np.cumsum(marks[:-1], dtype=np.int32) > 0

    def open_keys(self, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A key for each anchor that has open windows, the bytes of these one after another, and places of windows of
        stretches that repeat one of this block whole (which aren't sent)."""
        i = np.flatnonzero(open_)
        own = self.index[(self.least[i] & np.uint64(_FAR)).astype(np.int64)]
        new = np.ones(len(i), bool)
        new[1:] = (own[1:] != own[:-1]) | (i[1:] - i[:-1] > self.reach)
        first = np.flatnonzero(new)
        at, last = i[first], i[np.append(first[1:], len(i)) - 1] if len(i) else i
        keys = np.zeros(len(at), _OPEN)
        keys["k"], keys["at"], keys["n"] = self.hash[own[first]], at, last - at + 1
        # of equal stretches the first is sent: equal by place, anchor and bytes
        raw, seen, stays = self.block.data.tobytes(), set(), np.ones(len(at), bool)
        parts = []
        for j, (k, a, n, c) in enumerate(zip(keys["k"].tolist(), at.tolist(), keys["n"].tolist(), self.at[own[first]].tolist())):
            text = raw[a : a + n - 1 + self.window]
            if (one := (k, c - a, text)) in seen:
                stays[j] = False
            else:
                seen.add(one)
                parts.append(text)
        again = keys[~stays]
        total = int(again["n"].sum())
        repeats = np.repeat(again["at"].astype(np.int64), again["n"]) + np.arange(total) - np.repeat(np.cumsum(again["n"]) - again["n"], again["n"]).astype(np.int64)
        return keys[stays], np.frombuffer(b"".join(parts), np.uint8), repeats

    def covered(self, starts: np.ndarray) -> list[tuple[int, int, int]]:
        """(document, start, end) of the maximal runs of bytes that windows with these marks cover."""
        marks = np.zeros(len(self.block.data) + 1, np.int32)
        i = np.flatnonzero(starts)
        marks[i] += 1
        marks[i + self.window] -= 1
        inside = np.concatenate(([False], np.cumsum(marks[:-1], dtype=np.int32) > 0, [False]))
        a = np.flatnonzero(inside[1:] & ~inside[:-1])
        z = np.flatnonzero(~inside[1:] & inside[:-1])
        out = []
        for a, z in zip(a.tolist(), z.tolist()):
            d = int(np.searchsorted(self.block.ends, a, "right"))
            while z > self.block.ends[d]:  # a run may go on into the next document
                e = int(self.block.ends[d])
                if e > a:
                    out.append((d, a, e))
                a, d = e, d + 1
            out.append((d, a, z))
        return out


def judge_anchors(keys: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Place * 2 (+ 1: open) + 1 for each anchor whose context stood in a lower block, or that has several contexts."""
    order = np.lexsort((keys["at"], block, keys["c"], keys["k"]))
    k = keys[order]
    same_hash = np.zeros(len(k), bool)
    same_hash[1:] = k["k"][1:] == k["k"][:-1]
    same = same_hash.copy()
    same[1:] &= k["c"][1:] == k["c"][:-1]
    group = np.cumsum(~same_hash) - 1
    several = np.bincount(group[~same], minlength=1) > 1
    edge = ~same & several[group]
    out = np.zeros(len(k), np.uint32)
    out[order[same]] = (k["at"][same] << np.uint32(1)) + np.uint32(1)
    out[order[edge]] = (k["at"][edge] << np.uint32(1)) + np.uint32(2)
    return out


def told(words: np.ndarray) -> np.ndarray:
    return words - np.uint32(1)


def suffix_ranks(data: np.ndarray, window: int) -> np.ndarray:
    """Rank of the suffix at every position by its first window bytes (what lies past the end ranks lowest): prefix
    doubling from eight bytes on, and a last step that overlaps."""
    n = len(data)
    have = 8
    padded = np.concatenate((data, np.zeros(2 * window, np.uint8)))
    key = np.zeros(n, np.uint64)
    for k in range(min(have, window)):
        key = key << np.uint64(8) | padded[k : k + n]
    rank = np.unique(key, return_inverse=True)[1].astype(np.uint64) + np.uint64(1)
    while have < window:
        step = min(have, window - have)
        later = np.zeros(n, np.uint64)
        later[: max(0, n - step)] = rank[step:]
        rank = np.unique(rank << np.uint64(32) | later, return_inverse=True)[1].astype(np.uint64) + np.uint64(1)
        have += step
    return rank


def judge_open(keys: np.ndarray, block: np.ndarray, data: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(block, place of the window plus one) of every window in these stretches whose longest previous factor is window
    or more."""
    sizes = keys["n"].astype(np.int64) + window - 1
    begin = np.cumsum(sizes) - sizes
    total = int(keys["n"].sum())
    inside = np.arange(total) - np.repeat(np.cumsum(keys["n"]) - keys["n"], keys["n"]).astype(np.int64)
    at = np.repeat(begin, keys["n"]) + inside  # of each window, in data: it lies in its stretch, so no other one's bytes count
    place = np.repeat(keys["at"].astype(np.int64), keys["n"]) + inside
    of = np.repeat(block, keys["n"])
    rank = suffix_ranks(data, window)[at]
    order = np.lexsort((place, of, rank))  # the suffix array, cut at window bytes
    previous = np.zeros(len(order), bool)
    previous[1:] = rank[order[1:]] == rank[order[:-1]]  # the previous smaller place shares so many bytes
    hit = order[previous]
    return of[hit], (place[hit] + 1).astype(np.uint32)


def suffix_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id and the columns of REPORT: each document without what stood earlier."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = text_blocks(docs)
    n, stretched = buckets(blocks, _ANCHOR.itemsize / 30), buckets(blocks, STRETCHED)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = Sent()
        for block, _, _ in opened(batches):
            keys = Anchors(block, window).keys()
            new = sent.fresh(digests(keys, "k", "c"))  # a context that the task has sent stood earlier
            yield from dealt(block.number, n, keys[new])
            yield from known(block.number, (keys["at"][~new] << np.uint32(1)) + np.uint32(_REPEATS + 1))

    def send_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, b, i in opened(batches):
            anchors = Anchors(block, window)
            keys, data, _ = anchors.open_keys(anchors.settle(told(answers(b, i, "anchors")))[1])
            yield from dealt_text(block.number, stretched, keys, data, keys["n"].astype(np.int64) + window - 1)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, b, i in opened(batches):
            anchors = Anchors(block, window)
            starts, open_ = anchors.settle(told(answers(b, i, "anchors")))
            starts[anchors.open_keys(open_)[2]] = True
            starts[answers(b, i, "answers").astype(np.int64) - 1] = True
            yield report(block, anchors.covered(starts))

    about = cut(earlier(blocks.mapInArrow(send, DEALT), _ANCHOR, judge_anchors).withColumnRenamed("answers", "anchors"))
    stretches = blocks.join(about, "block", "left").mapInArrow(send_open, DEALT_TEXT)
    windows = cut(earlier_text(stretches, _OPEN, lambda keys, block, data: judge_open(keys, block, data, window)))
    return blocks.join(about, "block", "left").join(windows, "block", "left").mapInArrow(settle, f"doc_id {kind}, {REPORT}")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept_text", "spans")
