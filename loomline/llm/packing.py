"""Best-fit packing of tokenised documents in bulk-synchronous supersteps.

A superstep takes the pieces of one class of lengths, (capacity / 2^(c+1), capacity / 2^c], longest class first, and the
gaps that sequences have left:

1. Range sort. A gap of g offers g // h slots of the class's greatest length h, and one of what remains. Pieces and slots
   are dealt into ranges of rising size; of equal sizes a hash decides, so that a length that a third of all pieces have
   fills many ranges, and so do the slots of size h.
2. Successor sweep. Each range is swept by rising size: a slot takes the largest pieces before it that are left, which is
   to say that a piece goes to the nearest slot that holds it.
3. Conflicts by rank. What a range cannot match is ranked there. From the ranges' counts alone (a few rows a range) slots
   left over are given, interval by interval, to the largest pieces that lower ranges have left; equal ranks meet.
4. Pieces that no gap holds open sequences: of those of which k fit into the capacity, k of neighbouring rank share one.
5. Gaps shrink, and the next superstep follows.

Every sequence but the last of each k is more than half full when it is opened, so at the end there are at most as many
others as there are different k (about twice the capacity's square root, at any size of the corpus). They are read by the
driver and merged where two fit into one.

Best-fit decreasing piece by piece (sweep(), over a histogram of lengths) is what tests hold the number of sequences
against.

Nulls: a null text counts as empty and gives one piece of the end id alone. Rows that repeat or share a doc_id are
packed separately. Null doc_ids are kept. An empty table gives no rows. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.llm.common import cut, partitions, small_batches, table, together

CAPACITY, END_ID, VOCABULARY = 2048, 0, "word_bpe_49k.json"
#: Words whose ids a worker remembers, none longer than LONGEST bytes; later ones are encoded each time. In the pipeline
#: fewer, since its workers also hold what earlier stages left.
REMEMBERED, LONGEST, REMEMBERED_IN_STAGE = 900_000, 40, 150_000
#: Pieces and gaps that a range is to hold.
RANGE = 20_000
_BETWEEN = "\x01"
#: Words of a-z, U+00DF to U+00FF (less the sign of division), digits and ASCII punctuation but the apostrophe, and the
#: parts into which the vocabulary cuts them: runs of letters, single digits, runs of punctuation.
_PLAIN = re.compile(rb"(?:[!-&(-@\[-~]++|\xc3[\x9f-\xb6\xb8-\xbf])++")
_PARTS = re.compile(rb"(?:[a-z]++|\xc3[\x9f-\xb6\xb8-\xbf])++|[0-9]|[!-&(-/:-@\[-`{-~]++")
_MARKS = bytes(c for c in range(0x21, 0x7F) if c != 0x27 and not chr(c).isalnum())


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Words:
    """Ids of words (runs without white space), as little-endian unsigned 32-bit words.

    The vocabulary drops white space before it cuts words, so the ids of a text are those of its words one after
    another; it lower-cases, so A-Z may go first, except where combining marks might compose with the letter or where
    the text would hold a special token only then. It cuts plain words into parts, leaves these as they are, and ends each
    part with an id that stands nowhere else: their parts go to its merges alone, without its normaliser and pattern. A
    word seen before costs a lookup.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.remembered = Tokenizer.from_file(path), remembered
        self.merges = Tokenizer(self.tokenizer.model)  # shared, not read twice
        self.merges.normalizer = normalizers.Sequence([])
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.merges.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}
        (self.between,) = self.tokenizer.encode(_BETWEEN, add_special_tokens=False).ids

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Many words in one call, a mark between them."""
        mark = _BETWEEN.encode()
        out = {w: self._ids(w.decode("utf-8", "replace")) for w in words if mark in w}
        plain = [w for w in words if mark not in w]
        joined = (b" " + mark + b" ").join(plain).decode("utf-8", "replace")
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        raw, at = ids.tobytes(), (np.flatnonzero(ids == self.between) * 4).tolist()
        out.update(zip(plain, [raw[a:z] for a, z in zip([0, *(x + 4 for x in at)], [*at, len(raw)])]))
        return out

    def _merge(self, parts: list[bytes]) -> dict[bytes, bytes]:
        """Many parts of plain words in one call."""
        out = {}
        for k in range(0, len(parts), 1000):
            some = parts[k : k + 1000]
            ids = np.array(self.merges.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            raw, ends = ids.tobytes(), ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
            if len(ends) != len(some):
                raise ValueError("the vocabulary does not end each part of a word with an id of its own")
            out.update(zip(some, [raw[a:z] for a, z in zip([0, *ends], ends)]))
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = []
        for t in texts:
            low = t.lower()
            keep = b"\xcc" in t or b"\xcd" in t or any(x in low for x in self.special)
            split.append((t if keep else low).split())
        words = list(chain.from_iterable(split))
        known = self.known
        ids = list(map(known.get, words))
        missing = [i for i, x in enumerate(ids) if x is None]
        if missing:
            plain, other = {}, []
            for w in {words[i] for i in missing}:
                stem = w.rstrip(_MARKS)
                if any(x in w for x in self.special):
                    other.append(w)
                elif stem.isalpha() and stem.islower():  # ASCII alone, the most frequent kind
                    plain[w] = (stem, w[len(stem) :]) if len(stem) < len(w) else (w,)
                elif _PLAIN.fullmatch(w):
                    plain[w] = _PARTS.findall(w)
                else:
                    other.append(w)
            fresh = self._merge([p for p in set(chain.from_iterable(plain.values())) if p not in known])
            for w, parts in plain.items():
                if len(parts) > 1:
                    fresh[w] = b"".join([fresh[p] if p in fresh else known[p] for p in parts])
            if other:
                fresh.update(self._encode(other))
            for i in missing:
                ids[i] = fresh[words[i]]
            if len(known) < self.remembered:
                known.update((w, x) for w, x in fresh.items() if len(w) <= LONGEST)
        out, at = [], 0
        for own in split:
            out.append(b"".join(ids[at : at + len(own)]))
            at += len(own)
        return out


@lru_cache(2)
def _words(path: str, remembered: int) -> Words:
    return Words(path, remembered)


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids, cut only where longer than capacity."""
    small_batches(docs.sparkSession)
    kind, path = docs.schema["doc_id"].dataType.simpleString(), path or vocabulary_path()
    names = ["row", "piece", "start", "length", "ids_crc32"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = _words(path, remembered), END_ID.to_bytes(4, "little")
        for b in batches:
            at, size = 0, max(1, min(128, b.num_rows))
            while at < b.num_rows:
                part = b.slice(at, size)
                texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in part.column(1)]
                rows = []
                for i, ids in enumerate(words.encode(texts)):
                    ids += end
                    for k, s in enumerate(range(0, len(ids), 4 * capacity)):
                        p = ids[s : s + 4 * capacity]
                        rows.append((i, k, s // 4, len(p) // 4, zlib.crc32(p)))
                columns = dict(zip(names, map(np.array, zip(*rows))))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(columns["row"])), pa.array(columns["piece"], pa.int32()), *(pa.array(columns[c], pa.int64()) for c in names[2:])],
                    ["doc_id", *names[1:]],
                )
                at += size

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(of, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def sweep(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """counts: pieces of each length. Placements (length, low rank, end rank, first sequence, pieces a sequence,
    offset): the pieces of these ranks go to the sequences from the first on, so many to each, beginning at offset."""
    gaps: dict[int, list[tuple[int, int]]] = {}
    placed, opened = [], 0
    for length in sorted(counts, reverse=True):
        rank, end = 0, counts[length]
        for gap in sorted(g for g in gaps if g >= length):
            if rank == end:
                break
            fit, runs = gap // length, gaps.pop(gap)
            for first, n in runs:
                full = min(n, (end - rank) // fit)
                for at, many, each in ((first, full, fit), (first + full, min(1, n - full), (end - rank - full * fit) if full < n else 0)):
                    if many and each:
                        placed.append((length, rank, rank + many * each, at, each, capacity - gap))
                        rank += many * each
                        gaps.setdefault(gap - each * length, []).append((at, many))
                    elif many:
                        gaps.setdefault(gap, []).append((at, many))
                if (left := n - full - 1) > 0:
                    gaps.setdefault(gap, []).append((first + full + 1, left))
        if rank < end:
            fit = capacity // length
            full, rest = divmod(end - rank, fit)
            for many, each in ((full, fit), (min(1, rest), rest)):
                if many:
                    placed.append((length, rank, rank + many * each, opened, each, 0))
                    rank += many * each
                    gaps.setdefault(capacity - each * length, []).append((opened, many))
                    opened += many
    return placed


#: Kinds of tokens that are swept: a piece, or slots of a sequence.
_PIECE, _SLOT = 0, 1
_SWEPT = "part int, kind int, id long, size long, match long, rank long, n long"
_KINDS = [pa.int32(), pa.int32(), *[pa.int64()] * 5]


def sweep_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of tokens (part, kind, id, size, n), each by rising size. A matched piece has its sequence (match); what
    stays unmatched has its rank among the range's pieces or slots."""
    names = [x.split()[0] for x in _SWEPT.split(", ")]
    here, pending, spare = None, [], 0

    def made(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows[at : at + 10_000]), _KINDS)], names)

    def rest() -> Iterator[pa.RecordBatch]:
        yield from made([(here, _PIECE, id_, size, None, k, 1) for k, (id_, size) in enumerate(pending)])

    for b in batches:
        rows = []
        for part, kind, id_, size, n in zip(*(b.column(k).to_pylist() for k in range(5))):
            if part != here:
                yield from made(rows)
                yield from rest()
                here, pending, spare, rows = part, [], 0, []
            if kind == _PIECE:
                pending.append((id_, size))
                continue
            take = min(n, len(pending))
            for _ in range(take):
                pid, length = pending.pop()
                rows.append((part, _PIECE, pid, length, id_, None, 1))
            if n > take:
                rows.append((part, _SLOT, id_, size, None, spare, n - take))
                spare += n - take
        yield from made(rows)
    yield from rest()


Interval = tuple[int, int, int, int]


def _small(spark: SparkSession, rows: list[tuple], *names: str) -> DataFrame:
    """A few rows of whole numbers, as part of the plan (no task makes them), to be broadcast."""
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return F.broadcast(spark.createDataFrame(pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})))


def carried(left: dict[int, int], spare: dict[int, int]) -> tuple[list[Interval], list[Interval]]:
    """left: unmatched pieces of each range, spare: unmatched slots. Slots of a range serve the largest pieces that ranges
    below it still have, the nearest range first. Intervals (range, first rank, end rank, first match) of pieces and of
    slots; ranks of equal match meet."""
    below: list[list[int]] = []
    pieces, slots, match = [], [], 0
    for r in sorted({*left, *spare}):
        at = 0
        while at < spare.get(r, 0) and below:
            i, have = below[-1]
            take = min(spare[r] - at, have)
            pieces.append((i, have - take, have, match))
            slots.append((r, at, at + take, match))
            match, at = match + take, at + take
            below[-1][1] -= take
            if not below[-1][1]:
                below.pop()
        if left.get(r):
            below.append([r, left[r]])
    return pieces, slots


def _tokens(pieces_: DataFrame, gaps: DataFrame | None, lengths: dict[int, int], low: int, high: int, ranges: int) -> DataFrame:
    """Pieces of a class and the slots that gaps offer it, by range. lengths: how many pieces have each length."""
    own = sorted(n for n in lengths if low < n <= high)
    total, before, table_ = sum(lengths[n] for n in own), 0, []
    for n in range(low + 1, high + 1):  # a row for every size
        table_.append((n, before, lengths.get(n, 0)))
        before += lengths.get(n, 0)
    spark = pieces_.sparkSession
    sizes = _small(spark, table_, "size", "before", "many")
    one = F.lit(1).cast("long")
    tokens = pieces_.filter((F.col("length") > low) & (F.col("length") <= high)).select(F.lit(_PIECE).alias("kind"), F.col("pid").alias("id"), F.col("length").alias("size"), one.alias("n"), F.lit(0).cast("long").alias("gap"))
    if gaps is not None:
        slot = lambda size, n: gaps.select(F.lit(_SLOT).alias("kind"), F.col("sid").alias("id"), size.alias("size"), n.alias("n"), "gap").filter(F.col("n") > 0)
        whole, part = slot(F.lit(high).cast("long"), F.floor(F.col("gap") / high)), slot(F.col("gap") % high, one).filter(F.col("size") > low)
        tokens = tokens.unionByName(whole).unionByName(part)
    salt = F.pmod(F.xxhash64("id", "kind"), F.lit(1 << 20)) / (1 << 20)
    by_size = F.floor((F.col("before") + salt * F.col("many")) * ranges / max(1, total)).cast("int")
    top = F.lit(ranges) + F.floor(salt * ranges).cast("int")  # slots of the greatest size, above all pieces
    part = F.when((F.col("kind") == _SLOT) & (F.col("size") == high), top).otherwise(F.least(by_size, F.lit(ranges - 1)))
    dealt = tokens.join(sizes, "size").withColumn("part", part)
    return dealt.repartition(ranges, "part").sortWithinPartitions("part", "size", "kind", F.desc("gap")).select("part", "kind", "id", "size", "n")


def supersteps(pieces_: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces_: pid, length (cut). pid, sid (a sequence), length of each."""
    spark, most = pieces_.sparkSession, 4 * partitions(pieces_)
    tables = []
    lengths = {r.length: r.n for r in pieces_.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    placed = None
    opened, high = 0, capacity
    while high >= 1:
        low, now = high // 2, high
        high = low
        if not any(low < n <= now for n in lengths):
            continue
        ranges = min(most, 1 + (opened + sum(n for k, n in lengths.items() if low < k <= now)) // RANGE)
        gaps = None
        if opened:
            gaps = placed.groupBy("sid").agg((F.lit(capacity) - F.sum("length")).alias("gap")).filter(F.col("gap") > low)
        swept = cut(_tokens(pieces_, gaps, lengths, low, now, ranges).mapInArrow(sweep_ranges, _SWEPT))
        open_ = swept.filter("match is null").withColumn("fits", F.when(F.col("kind") == _PIECE, F.floor(F.lit(capacity) / F.col("size"))).otherwise(F.lit(0)))
        counts = open_.groupBy("part", "kind", "fits").agg(F.sum("n").alias("n"), F.min("rank").alias("first")).collect()  # a few rows a range
        left, spare = {}, {}
        for r in counts:
            of = left if r.kind == _PIECE else spare
            of[r.part] = of.get(r.part, 0) + r.n
        piece_at, slot_at = carried(left, spare)
        pairs = swept.filter("match is not null").select(F.col("id").alias("pid"), F.col("match").alias("sid"), F.col("size").alias("length"))
        stay = dict(left)  # the largest of a range are carried
        if piece_at:
            interval = ("part", "low", "high", "base")
            p = open_.filter(F.col("kind") == _PIECE).join(_small(spark, piece_at, *interval), "part").filter((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
            p = p.select(F.col("id").alias("pid"), F.col("size").alias("length"), (F.col("base") + F.col("rank") - F.col("low")).alias("m"))
            s = open_.filter(F.col("kind") == _SLOT).join(_small(spark, slot_at, *interval), "part")
            s = s.withColumns({"a": F.greatest("rank", "low"), "z": F.least(F.col("rank") + F.col("n"), "high")}).filter("a < z")
            s = s.select(F.col("id").alias("sid"), F.explode(F.sequence(F.col("base") + F.col("a") - F.col("low"), F.col("base") + F.col("z") - F.col("low") - 1)).alias("m"))
            pairs = pairs.unionByName(p.join(s, "m").select("pid", "sid", "length"))
            for i, first, _, _ in piece_at:
                stay[i] = min(first, stay[i])
        # pieces that stay, from the largest on: of one k, ranges one after another
        starts, many = [], {}
        for r in sorted((r for r in counts if r.kind == _PIECE), key=lambda r: (r.fits, r.part)):
            if n := min(r.n, stay[r.part] - r.first) if stay[r.part] > r.first else 0:
                starts.append((r.part, r.fits, r.first, many.get(r.fits, 0)))
                many[r.fits] = many.get(r.fits, 0) + n
        base = {}
        for k, n in many.items():
            base[k], opened = opened, opened + -(-n // k)
        if starts:
            table_ = _small(spark, [(*x, base[x[1]], stay[x[0]]) for x in starts], "part", "fits", "low", "before", "base", "stay")
            new = open_.filter(F.col("kind") == _PIECE).join(table_, ["part", "fits"]).filter(F.col("rank") < F.col("stay"))
            place = F.col("before") + F.col("rank") - F.col("low")
            pairs = pairs.unionByName(new.select(F.col("id").alias("pid"), (F.col("base") + F.floor(place / F.col("fits"))).alias("sid"), F.col("size").alias("length")))
        tables.append(cut(pairs.coalesce(ranges)))
        placed = together(tables)  # one scan: a task reads many small files, and later supersteps cost no more of them
    return pieces_.select("pid", F.col("pid").alias("sid"), "length").limit(0) if placed is None else placed


def merged(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sequences that are at most half full, few at any size of the corpus, put together where they fit."""
    fill = placed.groupBy("sid").agg(F.sum("length").alias("fill")).filter(F.col("fill") <= capacity // 2)
    into, room = [], []
    for r in sorted(fill.collect(), key=lambda r: (-r.fill, r.sid)):
        at = min((k for k in range(len(room)) if room[k][1] >= r.fill), key=lambda k: room[k][1], default=None)
        if at is None:
            room.append([r.sid, capacity - r.fill])
        else:
            into.append((r.sid, room[at][0]))
            room[at][1] -= r.fill
    if not into:
        return placed
    return placed.join(_small(placed.sparkSession, into, "sid", "into"), "sid", "left").select("pid", F.coalesce("into", "sid").alias("sid"), "length")


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ...)."""
    numbered = cut(cut_pieces.withColumn("pid", F.monotonically_increasing_id()))
    sequences = merged(supersteps(numbered.select("pid", "length"), capacity), capacity)
    in_order = Window.partitionBy("sid").orderBy(F.desc("length"), "pid")
    offsets = sequences.withColumn("offset", F.sum("length").over(in_order) - F.col("length"))
    return numbered.join(offsets.select("pid", F.col("sid").alias("sequence_id"), "offset"), "pid").select(*cut_pieces.columns, "sequence_id", "offset")


def packed(docs: DataFrame) -> DataFrame:
    return pack(pieces(docs))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: what is left, packed."""
    return pack(pieces(docs, remembered=REMEMBERED_IN_STAGE))
