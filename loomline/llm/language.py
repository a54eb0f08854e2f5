"""Language ID by error-correcting output codes.

Each language has a codeword; every column of the code splits the languages in two and has a binary classifier of byte
trigrams (naive Bayes log odds, languages weighing alike). A text's margin in a column is its mean log odds. Decoding
adds, over the columns, the logistic loss of the margins against a codeword, each weighted by how often that column's
classifier was right on that language in training, and takes the codeword of least loss. The score is that codeword's
share of exp(-loss); where it leads the second by less than AMBIGUOUS, the row is flagged.

Labels are counted over all rows that may be learned from. Training reads text and lang of about FIT_ROWS of these (the
documented bound; chosen by a hash, as many of each language as there are, so that a rare language is learned at any size
of the corpus), counts them on the executors and brings one table of trigram classes to the driver, whose size does not
depend on the corpus. Prediction reads whole texts.

Nulls: a null text, or one without a letter, is und with score 0, as is everything if no labelled row exists. Rows
without doc_id have a null held_out and are not learned from. Repeated rows are predicted alike. An empty table gives
no rows. Columns besides doc_id, text and (in training) lang are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import cut, padded, small_batches, table, text_views

FIT_ROWS, CLASSES, ALPHA, SHARPNESS, AMBIGUOUS = 6000, 1 << 15, 0.5, 6.0, 0.05
#: Languages that a model may tell apart: the most frequent ones, if labels name more.
MOST_LANGS = 2000
UNDETERMINED = "und"
_BLOCK = 1 << 19

#: Letters keep their (lower-cased) byte, bytes of longer characters stay, all else is one class.
_FOLD = np.full(256, 0x20, np.uint32)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def _trigrams(data: np.ndarray) -> np.ndarray:
    """The class of the trigram that starts at each byte but the last two."""
    b = _FOLD[data]
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    code *= np.uint32(0x9E3779B1)
    code >>= np.uint32(32 - CLASSES.bit_length() + 1)
    return code


def _segments(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For reduceat over trigrams: start of each padded text (of three bytes at least) and how many it has."""
    return offsets[:-1], np.diff(offsets) - 2


def code_matrix(k: int, seed: int = 7) -> np.ndarray:
    """Codewords (rows of +1 and -1): exhaustive for up to six languages, else random columns that differ."""
    if k < 2:
        return np.zeros((k, 0), np.int8)
    if k <= 6:
        columns = [[1] + [1 if bits >> i & 1 else -1 for i in range(k - 1)] for bits in range((1 << (k - 1)) - 1)]
        return np.array(columns, np.int8).T
    rng, seen = np.random.default_rng(seed), {}
    while len(seen) < math.ceil(10 * math.log2(k)):
        column = rng.choice(np.array([-1, 1], np.int8), k)
        column *= column[0]
        if (column != column[0]).any():
            seen[column.tobytes()] = column
    return np.array(list(seen.values()), np.int8).T


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    odds: np.ndarray
    weights: np.ndarray

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean log odds of each padded text in each column of the code."""
        grams = _trigrams(data)
        starts, n = _segments(offsets)
        # a text's trigrams end two bytes before the next text; the two that straddle are taken off again
        out = np.empty((len(n), self.odds.shape[0]))
        ends = offsets[1:-1]
        for j, odds in enumerate(self.odds):
            w = odds[grams]
            s = np.add.reduceat(w, starts, dtype=np.float64)
            s[:-1] -= w[ends - 2].astype(np.float64) + w[ends - 1]
            out[:, j] = s / n
        return out

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its share, its lead over the second."""
        if len(self.langs) == 1:
            return np.zeros(len(margins), np.int64), np.ones(len(margins)), np.ones(len(margins))
        z = SHARPNESS * margins[:, None, :] * self.code[None]
        loss = (self.weights[None] * np.logaddexp(0, -z)).sum(2) * len(self.code)
        loss -= loss.min(1, keepdims=True)
        share = np.exp(-loss)
        share /= share.sum(1, keepdims=True)
        order = np.sort(share, 1)
        return loss.argmin(1), order[:, -1], order[:, -1] - order[:, -2]


def held_out() -> Column:
    return (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3) == 1


def _padded() -> Column:
    return F.concat(F.lit("  "), F.coalesce(F.col("text"), F.lit("")), F.lit(" ")).cast("binary").alias("text")


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """docs: doc_id, text, lang; rows held out are not learned from."""
    spark = docs.sparkSession
    small_batches(spark)
    learn = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r.n for r in learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()}
    langs = sorted(sizes)
    # as many rows of each language, so that a rare one is learned too; what small ones leave goes to the others
    quota, left = {}, fit_rows
    for k, (lang, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        quota[lang] = min(n, max(1, left // (len(sizes) - k)))
        left -= quota[lang]
    shares = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(int(min(1.0, quota[lang] / sizes[lang]) * (1 << 31))))]) if langs else F.create_map(F.lit(""), F.lit(0))
    place = F.xxhash64("doc_id", "lang").bitwiseAND(F.lit((1 << 31) - 1))
    share = F.try_element_at(shares, F.col("lang"))
    sample = cut(learn.filter((place < share) | (share == 1 << 31)).select("lang", _padded()))
    code = code_matrix(len(langs))
    if not langs:
        return Model([], code, np.zeros((0, CLASSES), np.float32), np.zeros((0, 0)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((len(langs), CLASSES), np.int64)
        place = {lang: i for i, lang in enumerate(langs)}
        for b in batches:
            of = np.array([place[x] for x in b.column(0).to_pylist()])
            for at, end, data, offsets in text_views(b, "text", _BLOCK):
                grams = _trigrams(data)
                for i in range(end - at):
                    found[of[at + i]] += np.bincount(grams[offsets[i] : offsets[i + 1] - 2], minlength=CLASSES)
        lang, gram = np.nonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(gram, pa.int32()), pa.array(found[lang, gram])], ["lang", "gram", "n"])

    counted = sample.mapInArrow(count, "lang int, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(langs), CLASSES))
    counts[counted.lang, counted.gram] = counted.n
    shares = (counts + ALPHA) / (counts.sum(1, keepdims=True) + ALPHA * CLASSES)
    odds = np.array([np.log(shares[c > 0].mean(0)) - np.log(shares[c < 0].mean(0)) for c in code.T], np.float32).reshape(-1, CLASSES)
    model = Model(langs, code, odds, np.ones(code.shape))
    if len(langs) == 1:
        return model

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = np.zeros((len(langs), code.shape[1] + 1), np.int64)
        place = {lang: i for i, lang in enumerate(langs)}
        for b in batches:
            of = np.array([place[x] for x in b.column(0).to_pylist()])
            for at, end, data, offsets in text_views(b, "text", _BLOCK):
                ok = np.sign(model.margins(data, offsets)) == code[of[at:end]]
                np.add.at(hits, of[at:end], np.column_stack([ok, np.ones(end - at, np.int64)]).astype(np.int64))
        lang, bit = np.indices(hits.shape)
        yield pa.RecordBatch.from_arrays([pa.array(x.ravel(), pa.int64()) for x in (lang, bit, hits)], ["lang", "bit", "n"])

    hit = sample.mapInArrow(right, "lang long, bit long, n long").groupBy("lang", "bit").agg(F.sum("n").alias("n")).toPandas()
    hits = np.zeros((len(langs), code.shape[1] + 1))
    hits[hit.lang, hit.bit] = hit.n
    weights = hits[:, :-1] / np.maximum(1, hits[:, -1:]) + 1e-6
    model.weights = weights / weights.sum(1, keepdims=True)
    return model


def _judge(model: Model, batch: pa.RecordBatch, letter: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the index of its language (past the last: undetermined), its score, its lead over the second."""
    n = batch.num_rows
    best, score, lead = np.full(n, len(model.langs)), np.zeros(n), np.zeros(n)
    if model.langs:
        for at, end, data, offsets in text_views(padded(batch, "text", "  ", " "), "text", _BLOCK):
            best[at:end], score[at:end], lead[at:end] = model.decode(model.margins(data, offsets))
    mute = ~batch.column(letter).to_numpy(zero_copy_only=False).astype(bool)
    best[mute], score[mute], lead[mute] = len(model.langs), 0, 1
    return best, score, lead


def _letter() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    langs = np.array([*model.langs, UNDETERMINED], dtype=object)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, score, lead = _judge(model, b, "letter")
            columns = [b.column(0), pa.array(langs[best], pa.string()), pa.array(score), pa.array(lead < AMBIGUOUS)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", "text", _letter().alias("letter")).mapInArrow(of, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")


def determined(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, that have one language: neither undetermined nor ambiguous. Each row is judged and
    passed on or dropped where it is read."""
    small_batches(docs.sparkSession)
    unknown, columns = len(model.langs), docs.columns

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, _, lead = _judge(model, b, "__loom_letter")
            stays = pa.array((best != unknown) & (lead >= AMBIGUOUS))
            yield b.select(columns).filter(stays)

    return docs.withColumn("__loom_letter", _letter()).mapInArrow(of, docs.schema)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no letter), or between two, go; each row by its own text."""
    return determined(docs, fit(docs))
