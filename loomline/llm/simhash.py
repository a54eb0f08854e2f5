"""SimHash near-dedup through a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; the bit counts of the segments are its point in {0,1,2}^32.
One flipped bit moves one coordinate by one, so that the Manhattan distance of two points never exceeds the Hamming
distance of their fingerprints. Counts are written in unary (00, 01, 11), so that the Manhattan distance of two points is
the number of bits in which these differ.

The range join goes by a grid that refines itself. Points within Manhattan distance 2 differ in at most two of four
blocks of coordinates and so share the other two: the cells of a point are the six pairs of blocks. A cell of more than
CELL points is cut again in the same way: what its pair leaves free is halved into four blocks, of which points within
distance 2 share two again. Where all but two segments are fixed, segments of one bit follow (the counts of a cell's points
agree there, their bits may not); a cell that only leaves two bits free holds four fingerprints. So cells stay small at any
number of points and in any cluster, and nothing but their size decides how fine they are. Within a cell the Manhattan
bound prunes, the fingerprints verify exactly, and only links that span what is connected leave it.

Equal fingerprints are one point, so a group of copies costs one row. Components come from alternating large-star and
small-star rounds, each written to the shared folder; nothing goes to the driver but two numbers a round.

The pipeline's stage adds the links of texts whose word five-grams have a Jaccard similarity of 0.8 or more, which 64 bits
cannot tell from chance at any distance that a join could afford. Of n five-grams in an order that all texts share, rare
ones first, two such texts share one among their first n - 0.8 n + 1 (a prefix filter, exact with any order). Texts of the
same five-grams are one set. Sets that share a key are first compared with its middle, the one that shares most; then what
is left outside a key's largest component meets the rest of the key in cells of bounded size, where set sizes, the place of
the key and a parity sketch (its Hamming distance never exceeds the sets' difference) rule pairs out. What passes is
verified by the five-grams themselves. No pair of different components that could be similar goes unseen; the cells of a
key cost (left outside) x (size of the key) comparisons, so one key of many sets none of which is like another is the
expensive case.

Nulls and texts without words get fingerprint zero, linked like any other. A text of fewer words than a shingle is one
shingle. component_id is null only if every doc_id of a component is null. Rows that repeat stay separate rows in
simhash_components(). In the stage rows are told apart by doc_id and text, not by doc_id alone: of each group the row of
the smallest doc_id stays (nulls last; of one doc_id the text that sorts first by digest; of wholly repeated rows one). An
empty table gives no rows. Columns besides doc_id and text are not read, and pass through the stage whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import cut, drop, few_sent, grams, mix, partitions, prefix_hash, random_table, separated, small_batches, table, text_views, without_rows

SHINGLE, DISTANCE, SEED = 3, 2, 42
CELL = 512
_ODD = 0x5555555555555555
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)[:, ::-1].astype(np.int64)
_BLOCK = 1 << 19

def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned: bit b is 1 if set in over half the shingles' XXH64."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist())), np.uint64, n)
    bytes_ = hashes.astype("<u8").view(np.uint8).reshape(n, 8)
    counts = np.concatenate([np.bincount(bytes_[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint((t.as_buffer().to_pybytes()) if t.is_valid else b"", shingle, seed) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(of, f"doc_id {kind}, fp long")


def unary(fp: Column) -> Column:
    """The bit counts of the two-bit segments, in unary."""
    even, odd = fp.bitwiseAND(F.lit(_ODD)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_ODD))
    return even.bitwiseOR(odd).bitwiseOR(F.shiftleft(even.bitwiseAND(odd), 1))


def _pairs(point: Column, starts: list[Column], width: int) -> Column:
    """Of four blocks of coordinates (where they start, their width in bits), for every pair: which it is, the point's
    coordinates there, and where the two blocks that it leaves free start."""
    ones = F.lit((1 << width) - 1).cast("long")
    fields = [F.call_function("shiftrightunsigned", point, s).bitwiseAND(ones) for s in starts]
    out = []
    for i in range(4):
        for j in range(i + 1, 4):
            x, y = [starts[k] for k in range(4) if k not in (i, j)]
            out.append(F.struct(F.lit(4 * i + j).alias("pair"), fields[i].alias("p"), fields[j].alias("q"), x.alias("x"), y.alias("y")))
    return F.array(*out)


def _grid(points: DataFrame, point: Column, width: int, within: bool) -> DataFrame:
    """The cells of points (fp; within: cell, x, y, of which the free blocks at x and y are halved): fp, cell, x, y."""
    if within:
        half = F.lit(width).cast("int")
        starts = [F.col("x"), F.col("x") + half, F.col("y"), F.col("y") + half]
        before = [F.col("cell")]
    else:
        starts, before = [F.lit(k * width) for k in range(4)], [F.col("cell")] if "cell" in points.columns else []
    each = points.select("fp", *before, F.explode(_pairs(point, starts, width)).alias("c"))
    # a hash names the cell; two cells of one name would only be compared together
    return each.select("fp", F.xxhash64(F.lit(width), *before, "c.pair", "c.p", "c.q").alias("cell"), "c.x", "c.y")


def _labels(near: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each row of a boolean adjacency matrix."""
    label = np.arange(len(near))
    while True:
        new = np.where(near, label[None, :], len(near)).min(1)
        new = np.minimum(label, new)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def spanning_links(fps: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Of one cell: (fingerprint, the first that it is connected to), by the Manhattan bound and then exactly."""
    x = np.unique(fps.view(np.uint64))
    odd = np.uint64(_ODD)
    a, b = x & odd, (x >> np.uint64(1)) & odd
    point = (a | b) | ((a & b) << np.uint64(1))
    near = np.bitwise_count(point[:, None] ^ point[None, :]) <= distance
    i, j = np.nonzero(near)
    near[i, j] = np.bitwise_count(x[i] ^ x[j]) <= distance
    label = _labels(near)
    signed = x.view(np.int64)
    return [(int(signed[i]), int(signed[j])) for i, j in enumerate(label) if i != j]


def near_links(points: DataFrame, cell: int = CELL) -> DataFrame:
    """points: fp, distinct. Links (a, b) that connect all fingerprints within two bits of each other."""
    parts = partitions(points)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [p for c in b.column(0) for p in spanning_links(c.values.to_numpy())]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    found = None
    cells = _grid(points, unary(F.col("fp")), 16, False)
    # widths of the blocks: of two-bit segments down to a segment each, then of the bits themselves
    finer = [(unary, w, True) for w in (8, 4, 2)] + [(lambda fp: fp, 16, False)] + [(lambda fp: fp, w, True) for w in (8, 4, 2, 1)]
    for embed, width, within in [*finer, (None, 0, True)]:
        sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        shared = cut(cells.join(sizes, "cell"))
        own = shared.filter(F.col("n") <= cell) if embed else shared
        links = own.repartition(parts, "cell").groupBy("cell").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(link, "a long, b long")
        found = links if found is None else found.unionByName(links)
        large = shared.filter(F.col("n") > cell).drop("n")
        if not embed or large.isEmpty():
            break
        cells = _grid(large, embed(F.col("fp")), width, within)
    return found.distinct()


def components(links: DataFrame) -> DataFrame:
    """links: a, b. Returns node, root (the smallest node reachable) of every node that has a link."""

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    now = state(edges)
    while now[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.join(small, "a")
        new = met.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        edges = cut(new.filter("a <> b").distinct())
        before, now = now, state(edges)
        if now == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select("b", "b").toDF("node", "root").distinct())


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for each row of docs (doc_id, text)."""
    prints = cut(fingerprints(docs))
    points = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(near_links(points.select("fp")))
    placed = points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = cut(placed)
    first = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = placed.join(first, "root").select("fp", "component_id")
    return prints.join(of, "fp")


# --- similarity of word five-grams

SIMILAR_SHINGLE, SIMILARITY = 5, 0.8
#: Texts looked at to learn which five-grams are common, in how many of them those stand, and how many are kept. They
#: order the five-grams; what is found is the same with any order.
SAMPLE, COMMON, MOST = 20_000, 3, 500_000
#: Rows of either side of a comparison, and bits of the sketch that is compared there.
SIDE, SKETCH = 4096, 256
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BASE, _TABLE = 0xA0761D6478BD642F, random_table(41)


def space_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (a run without white space, A-Z lower-cased), and the text it is in. Texts end in a space."""
    folded = _FOLD[data]
    word = np.concatenate(([False], ~_SPACE[data], [False]))
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums, inverse = prefix_hash(folded, _TABLE, _BASE)
    return mix((sums[ends] - sums[starts]) * inverse[starts]), np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SIMILAR_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text's shingles, sorted within the text, one text after another; where each text's end."""
    words, of = space_words(data, offsets)
    texts = len(offsets) - 1
    n = np.bincount(of, minlength=texts)
    g = grams(words, size)
    i = np.flatnonzero(of[: len(g)] == of[size - 1 :]) if len(g) else np.zeros(0, np.int64)
    hashes, text = [g[i]], [of[i]]
    first = np.cumsum(n) - n
    for t in np.flatnonzero((n > 0) & (n < size)):
        hashes.append(grams(words[first[t] : first[t] + n[t]], int(n[t])))
        text.append(np.array([t]))
    h, t = np.concatenate(hashes), np.concatenate(text)
    order = np.lexsort((h, t))
    h, t = h[order], t[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return h[new], np.cumsum(np.bincount(t[new], minlength=texts))


def shingle_hashes(text: bytes, size: int = SIMILAR_SHINGLE) -> np.ndarray:
    data = np.frombuffer(text + b" ", np.uint8)
    return shingle_sets(data, np.array([0, len(data)]), size)[0]


def prefix_length(n: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    return np.where(n > 0, n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1, 0)


def rare_first(hashes: np.ndarray, ends: np.ndarray, common: np.ndarray, times: np.ndarray, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Of each text's shingles by rising times and then hash the part of which any text as similar holds one in its own
    part; where the texts' parts end. common is sorted."""
    n = np.diff(ends, prepend=0)
    text = np.repeat(np.arange(len(ends)), n)
    if len(common):
        k = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        order = np.lexsort((hashes, np.where(common[k] == hashes, times[k], 0), text))
        hashes = hashes[order]
    take = prefix_length(n, similarity)
    place = np.arange(len(hashes)) - np.repeat(ends - n, n)
    return hashes[place < np.repeat(take, n)], np.cumsum(take)


def sketch(hashes: np.ndarray) -> bytes:
    """Parities of how many shingles fall to each of so many bits, at least about as many bits as shingles."""
    bits = SKETCH
    while bits < len(hashes):
        bits *= 2
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(s: bytes, size: int = SKETCH // 8) -> np.ndarray:
    """A sketch at a lower number of bits."""
    return np.bitwise_xor.reduce(np.frombuffer(s, np.uint8).reshape(-1, size), axis=0)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many of the sampled texts hold, sorted, and in how many."""
    share = min(1.0, SAMPLE / max(1, texts.count()))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, offsets in text_views(b, "text", _BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(data, offsets)[0].view(np.int64))], ["h"])

    some = texts.filter(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else texts
    got = some.select(separated("text")).distinct().mapInArrow(each, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COMMON)
    got = got.orderBy(F.desc("n"), "h").limit(MOST).toPandas()
    h, n = got.h.to_numpy(np.int64).view(np.uint64), got.n.to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def looked_at(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """rows: doc_id, row (what tells rows of one doc_id apart), text. For each row its fingerprint, its set of shingles (id:
    a digest; size, sketch, and the sketch folded to SKETCH bits) and that set's keys."""
    small_batches(rows.sparkSession)
    kind = rows.schema["doc_id"].dataType.simpleString()
    common, times = _common(rows)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, end, data, offsets in text_views(b, "text", _BLOCK):
                hashes, ends = shingle_sets(data, offsets)
                keys, key_ends = rare_first(hashes, ends, common, times, similarity)
                sets = np.split(hashes, ends[:-1])
                raw = data.tobytes()
                fps = [fingerprint(raw[s:e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], key_ends)).astype(np.int32)), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(at, end - at),
                        b.column(1).slice(at, end - at),
                        pa.array(np.array(fps, np.uint64).view(np.int64)),
                        pa.array([xxhash.xxh3_64_intdigest(h.tobytes()) for h in sets], pa.uint64()).view(pa.int64()),
                        pa.array([len(h) for h in sets], pa.int32()),
                        pa.array(sketches := [sketch(h) for h in sets], pa.binary()),
                        pa.array([folded(x).tobytes() for x in sketches], pa.binary()),
                        listed,
                    ],
                    ["doc_id", "row", "fp", "id", "n", "sketch", "fold", "keys"],
                )

    schema = f"doc_id {kind}, row string, fp long, id long, n int, sketch binary, fold binary, keys array<long>"
    return cut(rows.select("doc_id", "row", separated("text")).mapInArrow(look, schema))


def _could(similarity: float, x: tuple[str, str], y: tuple[str, str]) -> Column:
    """Whether sets (size, place of the shared key) can be that similar, as far as sizes and places tell."""
    (n, i), (m, j) = [[F.col(c) for c in side] for side in (x, y)]
    return F.least(n - i, m - j) >= (n + m) * (similarity / (1 + similarity)) - 1e-6


def _meet(rows: dict[str, np.ndarray], similarity: float) -> np.ndarray:
    """Pairs (smaller id first) of one comparison, side a with side b, of different components, that nothing rules out."""
    out = [np.zeros((0, 2), np.int64)]
    a, b = np.flatnonzero(rows["a"]), np.flatnonzero(rows["b"])
    n, left, words, root, ids = rows["n"], rows["n"] - rows["i"], rows["fold"], rows["root"], rows["id"]
    for part in np.array_split(a, max(1, len(a) * len(b) >> 20)):
        total = n[part, None] + n[None, b]
        ok = (root[part, None] != root[None, b]) & (np.minimum(left[part, None], left[None, b]) >= total * (similarity / (1 + similarity)) - 1e-6)
        i, j = np.nonzero(ok)
        apart = np.bitwise_count(words[part[i]] ^ words[b[j]]).sum(1, dtype=np.int64)
        keep = apart <= total[i, j] * ((1 - similarity) / (1 + similarity)) + 1e-6
        pair = np.column_stack([ids[part[i[keep]]], ids[b[j[keep]]]])
        out.append(np.unique(np.sort(pair, axis=1), axis=0))
    return np.concatenate(out)


def similar_links(rows: DataFrame, looked: DataFrame, similarity: float = SIMILARITY, side: int = SIDE) -> DataFrame:
    """rows, and the sets that looked_at() found in them (cut; a row for each id, at: doc_id and row of a text that has
    it). a, b: ids of verified similarity that connect all similar ones."""
    place = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("i").cast("long"))
    keyed = looked.select("id", "n", F.posexplode("keys").alias("i", "key")).select("key", "id", place.alias("place"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    n, i = F.shiftright("place", 32).cast("int"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    shared = cut(keyed.join(sizes, "key").select("key", "id", n.alias("n"), i.alias("i"), "m"))
    sets = cut(looked.drop("keys"), few=True)
    drop(looked)

    def rough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y, n, m in zip(*(b.column(k).to_pylist() for k in range(2, 6))):
                size = min(len(x), len(y))
                apart = int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())
                ok.append(apart <= (n + m) * ((1 - similarity) / (1 + similarity)) + 1e-6)
            yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(ok, pa.bool_())) for k in (0, 1)], ["a", "b"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= similarity for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(ok, pa.bool_())) for k in (0, 1)], ["a", "b"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, end, data, offsets in text_views(b, "text", _BLOCK):
                hashes, ends = shingle_sets(data, offsets)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, end - at), pa.array([h.tobytes() for h in np.split(hashes, ends[:-1])], pa.binary())], ["id", "hashes"])

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    def both(pairs: DataFrame, of: DataFrame, *columns: str) -> DataFrame:
        for s in ("a", "b"):
            pairs = pairs.join(of.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in columns]), s)
        return pairs.select("a", "b", *[f"{c}_{s}" for c in columns for s in ("a", "b")])

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
        pairs = cut(both(pairs, sets, "sketch", "n").mapInArrow(rough, "a long, b long"), few=True)
        needed = sets.join(ends(pairs), "id", "left_semi").select("id", F.col("at.doc_id").alias("__id"), F.col("at.row").alias("__row"))
        texts = rows.join(few_sent(cut(needed, few=True)), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("row") == F.col("__row")))
        made = cut(texts.select("id", separated("text")).mapInArrow(whole, "id long, hashes binary").dropDuplicates(["id"]), few=True)
        return cut(both(pairs, made, "hashes").mapInArrow(exact, "a long, b long"), few=True)

    # each set with the middle of its key: the one that shares most, as an original among its edited copies does
    score = shared.groupBy("id").agg(F.sum("m").alias("score"))
    middle = shared.join(score, "id").groupBy("key").agg(F.max(F.struct("score", "id", "n", "i")).alias("c")).select("key", F.col("c.id").alias("c"), F.col("c.n").alias("cn"), F.col("c.i").alias("ci"))
    near = verified(shared.join(middle, "key").filter(_could(similarity, ("n", "i"), ("cn", "ci"))).select(F.col("id").alias("a"), F.col("c").alias("b")))

    # what a key still holds outside its largest component, with all of the key that is not connected to it
    placed = cut(shared.join(components(near).withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")), few=True)
    top = F.max(F.struct("k", "root"))
    open_ = (
        placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("key").agg(top["root"].alias("most"), F.sum("k").alias("all"), (F.sum("k") - top["k"]).alias("out")).filter("out > 0")
    )
    # where a key has two sets, one of them is its middle
    rest = placed.join(open_.filter(F.col("all") > 2), "key").join(sets.select("id", "fold"), "id")
    slices, parts = [F.ceil(F.col(c) / side).cast("int") for c in ("all", "out")]
    once = (slices == 1) & (parts == 1)
    apart = F.col("root") != F.col("most")
    own_part, own_slice = F.pmod(F.xxhash64("id"), parts).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), slices).cast("int")
    cell = lambda p, s, a, b: F.struct(p.alias("p"), s.alias("s"), a.alias("a"), b.alias("b"))
    yes, no, zero = F.lit(True), F.lit(False), F.lit(0)
    as_a = F.when(apart, F.transform(F.sequence(zero, slices - 1), lambda s: cell(own_part, s, yes, no))).otherwise(F.array().cast("array<struct<p:int,s:int,a:boolean,b:boolean>>"))
    as_b = F.transform(F.sequence(zero, parts - 1), lambda p: cell(p, own_slice, no, yes))
    cells = F.when(once, F.array(cell(zero, zero, apart, yes))).otherwise(F.concat(as_a, as_b))
    met = rest.withColumn("cell", F.explode(cells)).groupBy("key", "cell.p", "cell.s").agg(F.collect_list(F.struct("id", "root", "n", "i", "fold", F.col("cell.a").alias("a"), F.col("cell.b").alias("b"))).alias("rows"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.zeros((0, 2), np.int64)]
            for group in b.column(0):
                v = group.values
                columns = {c: v.field(c).to_numpy(zero_copy_only=False) for c in ("id", "root", "n", "i", "a", "b")}
                columns["fold"] = np.frombuffer(b"".join(v.field("fold").to_pylist()), np.uint64).reshape(len(v), -1)
                found.append(_meet(columns, similarity))
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, k]) for k in (0, 1)], ["a", "b"])

    return near.unionByName(verified(met.select("rows").mapInArrow(meet, "a long, b long")))


def sets_of(looked: DataFrame) -> DataFrame:
    """Of what looked_at() made: a row for each set of shingles."""
    first = lambda c: F.first(c).alias(c)
    return cut(looked.filter("n > 0").groupBy("id").agg(F.min(F.struct("doc_id", "row")).alias("at"), *map(first, ("n", "sketch", "fold", "keys"))), few=True)


def grouped(rows: DataFrame) -> DataFrame:
    """rows: doc_id, row, text. doc_id, row and root (a fingerprint) of what fingerprints or similar texts connect."""
    looked = looked_at(rows)
    near = components(near_links(looked.select("fp").distinct())).withColumnRenamed("node", "fp")
    of = cut(looked.join(near, "fp", "left").select("doc_id", "row", F.when(F.col("n") > 0, F.col("id")).alias("id"), F.coalesce("root", "fp").alias("root")), few=True)
    sets = sets_of(looked)
    drop(looked)
    # a set's components are one, and so are those of similar sets: links between components
    first = of.groupBy("id").agg(F.min("root").alias("first"))
    same = of.join(first, "id").filter("root <> first").select(F.col("root").alias("a"), F.col("first").alias("b"))
    links = similar_links(rows, sets)
    for s in ("a", "b"):
        links = links.join(first.select(F.col("id").alias(s), F.col("first").alias(f"{s}_root")), s)
    joined = components(same.unionByName(links.select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))).distinct())
    last = joined.select(F.col("node").alias("root"), F.col("root").alias("last"))
    return of.join(last, "root", "left").select("doc_id", "row", F.coalesce("last", "root").alias("root"))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("row"), "text")


def similar_components(docs: DataFrame) -> DataFrame:
    """doc_id, component_id (the smallest doc_id that fingerprints or similar text connect it to)."""
    found = cut(grouped(_rows(docs)))
    return found.join(found.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group, of fingerprints and similar texts, one document stays: that of the smallest doc_id."""
    found = cut(grouped(_rows(docs)), few=True)
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    kept = found.groupBy("root").agg(F.min(place).alias("best"), F.min_by(F.struct("doc_id", "row"), place).alias("r")).select("root", F.col("r.doc_id").alias("k_id"), F.col("r.row").alias("k_row"))
    judged = found.join(kept, "root").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("row") == F.col("k_row")))
    return without_rows(docs, judged.select("doc_id", "row", "stays"), F.md5(F.coalesce("text", F.lit(""))))
