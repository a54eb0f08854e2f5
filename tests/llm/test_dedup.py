"""Exact dedup, SimHash, chunk and suffix dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomline.llm import chunk_dedup, exact_dedup, simhash, suffix_dedup
from loomline.llm.blocks import Block
from loomline.sources import tables

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EDGES = [(1, None), (2, ""), (3, "É a"), (4, "é a"), (5, "É A"), (6, "x" * 300_000), (7, "X" * 300_000), (7, "X" * 300_000), (None, "same"), (8, "Same"), (9, "a\x00b"), (10, "   ")]


def test_exact_groups_match_brute_force(docs_of):
    rng = random.Random(1)
    rows = EDGES + [(100 + i, rng.choice(["Hot Copy", f"t{i % 30}", f"T{i % 30}"])) for i in range(400)]
    got = exact_dedup.exact_dedup(docs_of(rows)).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    want = []
    for i, t in rows:
        key = (t or "").translate(LOWER)
        keep = max((x for x in groups[key] if x is not None), default=None)
        want.append((i, keep, len(groups[key]), i == keep, hashlib.sha256(key.encode()).hexdigest()))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_exact_split_takes_both_ways(docs_of):
    rows = [(i, "hot" if i % 2 else f"cold {i}") for i in range(60)]
    got = {r.doc_id: r for r in exact_dedup.exact_groups(docs_of(rows), heavy=2, tracked=8).collect()}
    assert got[1].group_size == 30 and got[1].keep_id == 59 and got[2].group_size == 1


def test_exact_empty_and_stage(spark, docs_of):
    assert exact_dedup.exact_dedup(docs_of(EDGES).limit(0)).count() == 0
    kept = exact_dedup.stage(spark, docs_of(EDGES), "")
    assert kept.columns == docs_of(EDGES).columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [2, 4, 5, 7, 8, 9, 10]  # the repeated row of 7 once


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, distance=2):
    x = np.array(fps, np.uint64)
    label = list(range(len(x)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= distance):
            a, b = root(i), root(int(j))
            label[max(a, b)] = min(a, b)
    smallest = {}
    for i, d in enumerate(ids):
        if d is not None:
            smallest[root(i)] = min(smallest.get(root(i), d), d)
    return [smallest.get(root(i)) for i in range(len(ids))]


def test_fingerprints_are_spark_s_own_hash(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a é c"))).first()[0] == np.uint64(xxhash.xxh64_intdigest("a é c".encode(), 42)).astype(np.int64)


def test_simhash_matches_brute_force(docs_of):
    rng = random.Random(2)
    base = [[rng.choice("abcdefgh") * rng.randint(1, 6) for _ in range(120)] for _ in range(12)]
    rows = list(EDGES)
    for i in range(250):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = "edit" + str(rng.randint(0, 3))
        rows.append((100 + i, " ".join(words)))
    got = simhash.simhash_components(docs_of(rows)).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    want = brute_components([i for i, _ in rows], fps)
    assert sorted(str((r.doc_id, np.int64(r.fp).astype(np.uint64), r.component_id)) for r in got) == sorted(str((i, np.uint64(f), c)) for (i, _), f, c in zip(rows, fps, want))


@pytest.mark.parametrize("cell", [4, 8, 512])
def test_links_span_all_near_pairs(spark, cell):
    """Dense clusters through small cells, large cells, and both."""
    rng = random.Random(3)
    fps = set()
    for _ in range(6):
        c = rng.getrandbits(64)
        for _ in range(60):
            fps.add(c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (rng.getrandbits(1) << rng.randrange(64)))
    fps = sorted(fps)
    points = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.near_links(points, cell)).collect()}
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    got = [roots.get(f, f) for f in signed]
    assert got == brute_components(signed, fps)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.root for r in simhash.components(links).collect()} == {0}
    assert simhash.components(links.limit(0)).count() == 0


def test_simhash_empty_and_stage(spark, docs_of):
    assert simhash.simhash_components(docs_of(EDGES).limit(0)).count() == 0
    kept = simhash.stage(spark, docs_of([(1, "a b c d"), (2, "a b c d"), (3, "other words here"), (4, None), (5, "")]), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


@pytest.mark.parametrize("stage", [exact_dedup.stage, simhash.stage])
def test_stages_tell_rows_of_one_doc_id_apart(spark, docs_of, stage):
    long = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, long), (1, "quite another text"), (2, long), (2, long), (None, "a third text of its own"), (None, long), (3, "a third text of its own"), (4, "last one here"), (4, "last one here")]
    kept = sorted((str(r.doc_id), r.text) for r in stage(spark, docs_of(rows), "").collect())
    best = 2 if stage is exact_dedup.stage else 1
    assert kept == sorted([(str(best), long), ("1", "quite another text"), ("3", "a third text of its own"), ("4", "last one here")])


def links_by_id(docs, sets, side=4096):
    """The similar sets, as links between doc_ids (texts of one set are linked as well)."""
    rows = simhash._rows(docs)
    ids = {}
    for i, h in sets.items():
        ids.setdefault(int(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).astype(np.int64)), []).append(i)
    links = [(ids[r.a][0], ids[r.b][0]) for r in simhash.similar_links(rows, simhash.sets_of(simhash.looked_at(rows)), side=side).collect()]
    return links + [(own[0], i) for own in ids.values() for i in own[1:]]


@pytest.mark.parametrize("side", [4096, 3])
def test_similar_texts_are_found_and_others_left(spark, docs_of, side):
    """Copies with a few words changed, at 0.8 and more, against all pairs."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    base = [[word() for _ in range(rng.choice([8, 60, 120, 400]))] for _ in range(25)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 5])):
            words[rng.randrange(len(words))] = word()
        rows.append((100 + i, " ".join(words)))
    rows += [(900, None), (901, ""), (None, rows[0][1])]
    ids = [i for i, t in rows if t and i is not None]
    sets = {i: simhash.shingle_hashes(t.encode()) for i, t in rows if t}
    got = links_by_id(docs_of(rows), sets, side)
    assert all(simhash.jaccard(sets[a], sets[b]) >= 0.8 for a, b in got)
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in got:
        label[root(b)] = root(a)
    near = [(a, b) for a in ids for b in ids if a < b and simhash.jaccard(sets[a], sets[b]) >= 0.8]
    assert len(near) > 100 and all(root(a) == root(b) for a, b in near)
    assert links_by_id(docs_of([]).limit(0), {}) == []


@pytest.mark.parametrize("copies", [30, 2000])
def test_edited_copies_meet_through_their_original(docs_of, copies):
    """Each copy is 0.8 similar to the original and to hardly any other copy."""
    rng = random.Random(copies)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9)))
    base = [word() for _ in range(100)]
    texts = [" ".join(base)]
    for _ in range(copies):
        words = list(base)
        for k in rng.sample(range(100), 2):
            words[k] = word()
        texts.append(" ".join(words))
    ids = rng.sample(range(10 * copies), len(texts))
    rows = list(zip(ids, texts)) + [(100_000 + i, " ".join(word() for _ in range(100))) for i in range(20)]
    sets = {i: simhash.shingle_hashes(t.encode()) for i, t in rows}
    assert all(simhash.jaccard(sets[ids[0]], sets[i]) >= 0.8 for i in ids)
    links = links_by_id(docs_of(rows), sets)
    groups = {i: {i} for i in sets}
    for a, b in links:
        if groups[a] is not groups[b]:
            both = groups[a] | groups[b]
            for k in both:
                groups[k] = both
    assert groups[ids[0]] == set(ids)


def repeated_passages(seed):
    rng = random.Random(seed)
    passages = [bytes(rng.choice(b"abcd ") for _ in range(rng.randint(60, 400))) for _ in range(6)] + [b"a" * 300, b"ab" * 200]
    docs = []
    for _ in range(rng.randint(3, 40)):
        t = b""
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            t += p[a : a + rng.randint(0, 400)] + bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 60)))
        docs.append(t.decode())
    return docs


def brute_suffix(texts, window=100):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - window + 1):
            w = b[i : i + window]
            if w in seen:
                gone[i : i + window] = True
            else:
                seen.add(w)
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int), [0]))) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_suffix_dedup_matches_brute_force(docs_of, seed, monkeypatch):
    texts = repeated_passages(seed) + [None, "", "é" * 400, "short"]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(docs_of(list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == brute_suffix(texts)


def test_suffix_dedup_over_many_blocks(docs_of, monkeypatch):
    from loomline.llm import blocks

    texts = repeated_passages(7) * 3
    small = blocks.text_blocks
    monkeypatch.setattr(suffix_dedup, "text_blocks", lambda d: small(d, 500))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(docs_of(list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == brute_suffix(texts)


def test_suffix_dedup_repeated_rows_and_empty(docs_of):
    text = "".join(chr(97 + i % 26) + str(i) for i in range(100))
    rows = suffix_dedup.suffix_dedup(docs_of([(1, text), (1, text), (None, text)])).collect()
    assert sorted((r.doc_id or 0, r.n_removed > 0) for r in rows) == [(0, False), (1, True), (1, True)]
    assert rows[0].kept_text is not None
    assert suffix_dedup.suffix_dedup(docs_of([]).limit(0)).count() == 0


def block_of(data):
    return Block(0, None, np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]))


def test_gear_is_the_byte_by_byte_hash():
    data = bytes(random.Random(4).randrange(256) for _ in range(400))
    h, want = 0, []
    for b in data:
        h = ((h << 1) + int(chunk_dedup._GEAR[b])) & 0xFFFF
        want.append(h)
    assert chunk_dedup.gear(np.frombuffer(data, np.uint8))[16:].tolist() == want[16:]


def test_chunks_tile_the_text_and_resist_shifts():
    rng = random.Random(5)
    data = bytes(rng.randrange(97, 123) for _ in range(5000))
    begin, end, _ = chunk_dedup.chunk_bounds(block_of(data))
    assert begin[0] == 0 and end[-1] == 5000 and (begin[1:] == end[:-1]).all()
    assert (end - begin).min() >= chunk_dedup.MIN_CHUNK and (end - begin)[:-1].max() <= chunk_dedup.MAX_CHUNK
    own = {data[a:b] for a, b in zip(begin, end)}
    moved = data[:700] + b"INSERTED" + data[700:]
    b2, e2, _ = chunk_dedup.chunk_bounds(block_of(moved))
    assert len([1 for a, b in zip(b2, e2) if moved[a:b] not in own]) <= 6


def brute_chunks(texts, min_run=chunk_dedup.MIN_RUN):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        begin, end, _ = chunk_dedup.chunk_bounds(block_of(b))
        spans = []
        for a, z in zip(begin.tolist(), end.tolist()):
            if b[a:z] not in seen:
                seen.add(b[a:z])
            elif spans and spans[-1][1] == a:
                spans[-1][1] = z
            else:
                spans.append([a, z])
        whole = lambda a, z: (a == 0 or b[a - 1] == 10) and (z == len(b) or b[z - 1] == 10 or b[z] == 10)  # noqa: B023, E731
        out.append((len(b), sum(z - a for a, z in spans if z - a >= min_run or whole(a, z)), len(begin)))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_chunk_dedup_matches_brute_force(docs_of, seed):
    texts = repeated_passages(seed + 20) + [None, "", "x", "long " * 30_000, "a short text", "a short text", "in a short text of", "twenty letters or so\n", "twenty letters or so\nand then more"]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_chunks) for r in chunk_dedup.chunk_dedup(docs_of(list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == brute_chunks(texts)
    assert chunk_dedup.chunk_dedup(docs_of([]).limit(0)).count() == 0


def test_chunk_dedup_over_many_blocks(docs_of, monkeypatch):
    from loomline.llm import blocks

    texts = repeated_passages(23) * 3
    small = blocks.text_blocks
    monkeypatch.setattr(chunk_dedup, "text_blocks", lambda d: small(d, 500))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_chunks) for r in chunk_dedup.chunk_dedup(docs_of(list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == brute_chunks(texts)


def test_a_task_sends_a_key_once():
    from loomline.llm import blocks

    sent = blocks.Sent()
    assert sent.fresh([b"a", b"b"]).tolist() == [True, True] and sent.fresh([b"b", b"c"]).tolist() == [False, True]
    sent.MOST = 3
    assert sent.fresh([b"d"]).tolist() == [True] and sent.fresh([b"d", b"a"]).tolist() == [True, False]


def test_passage_of_fifty_words_is_found(docs_of):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    shared = " ".join(word() for _ in range(55))
    rows = [(i, " ".join(word() for _ in range(80)) + " " + (shared if i % 2 else "") + " " + " ".join(word() for _ in range(80))) for i in range(40)]
    got = {r.doc_id: r for r in chunk_dedup.chunk_dedup(docs_of(rows)).collect()}
    assert all((got[i].n_removed > 0) == (i % 2 == 1 and i > 1) for i in range(40))


def test_small_cuts_write_few_files(spark):
    """Each file written costs processes on a local file system; a small table needs one, however many cores there are."""
    rows = spark.range(1_200_000).groupBy((F.col("id") * 7919 % 1_000_003).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    before = spark.conf.get(tables.SPREAD, None)
    few, spread = tables.cut(rows, few=True), tables.cut(rows)
    assert len(few.inputFiles()) == 1 < len(spread.inputFiles())
    assert few.exceptAll(spread).isEmpty() and few.count() == spread.count()
    assert spark.conf.get(tables.SPREAD, None) == before
