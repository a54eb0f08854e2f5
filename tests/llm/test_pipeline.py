"""The pipeline's stages, each on its own input, and the whole run."""

import zlib

import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from loomline.llm import catalog, exact_dedup, simhash

SF = "/root/testdata/sf0.001"


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "simhash", "decontamination", "packing"]
    assert {n.split("_")[0] for n in catalog.queries()} == {f"op{i}" for i in range(1, 11)} | {"pipeline"}


def test_oracles(spark):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in catalog.oracle_sql().items():
        got, want = catalog.queries()[name](spark, SF).toPandas(), con.sql(sql).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        key = lambda f: sorted(tuple(map(str, r)) for r in f[columns].itertuples(index=False))
        assert key(got) == key(want) and len(got)


def test_run_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    last = {t.translate(lower): i for i, t in zip(docs.doc_id, docs.text)}
    left = docs[[last[t.translate(lower)] == i for i, t in zip(docs.doc_id, docs.text)]]
    rows = list(left.sort_values("doc_id").itertuples())
    prints = np.array([simhash.fingerprint(r.text.encode()) for r in rows], np.uint64)
    grams = []
    for r in rows:
        w = r.text.encode().lower().split()
        grams.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(grams[i] & grams[j])
            if np.bitwise_count(prints[i] ^ prints[j]) <= 2 or both >= 0.8 * (len(grams[i]) + len(grams[j]) - both):
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    kept = [r for i, r in enumerate(rows) if root(i) == i]
    kept = [r for r in kept if not any(b in r.text for b in bench.text)]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in kept:
        ids = tokenizer.encode(r.text, add_special_tokens=False).ids + [0]
        want += [(r.doc_id, k, zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in got) == sorted(want)


def test_stages_take_clashing_columns_and_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 AS keep_id", "2 AS digest", "'x' AS fp", "3 AS kept_id", "4 AS score", "5 AS item_id", "6 AS component_id", "7 AS letter")
    for rows in (docs, docs.limit(0)):
        now = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, SF)
            assert now.columns == docs.columns
        n = corpus_pipeline.STAGES[-1][1](spark, now, SF).count()
        assert (n > 0) == (rows is docs)


def test_modules_leave_the_rest_alone():
    assert exact_dedup.__name__.startswith("loomline.llm")
