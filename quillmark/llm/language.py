"""Language identification by the nearest of several centroids for each language.

A text is its vector of hashed byte n-grams (1 to 3 bytes of the lower-cased text, ASCII other
than letters read as one space), term frequencies damped by a logarithm, weighted by inverse
document frequency and normalised. Each language has up to CENTROIDS centroids, found by
spherical k-means. The prediction is the language of the centroid of greatest cosine, which
is the score; a text further than REJECT from all centroids is rejected.

Training reads labelled rows only, at most TRAIN_ROWS for each language, chosen by the hash
of their ids. The inverse document frequencies are those of this sample.

REJECT lies between what the tables' four languages and others give: of the documents of the
smaller tables the furthest, of three words, is at 0.66, texts in other alphabets and languages,
code and hexadecimal digits at 0.83 and more. Of equal cosines the first centroid counts, by the
languages' order. No documents give no rows.

A text that is null or has no letter is `und`, score 0, rejected. So is every text if there
is nothing to learn from. Rows are judged one by one; repeated rows and ids stay; lang,
source and doc_id are no inputs of a prediction.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

BUCKETS, TRAIN_ROWS, CENTROIDS, ROUNDS, REJECT = 1 << 13, 600, 4, 10, 0.75
#: Bytes of a text that are counted at once.
_PART = 1 << 22
_TEXTS_AT_ONCE = 256
_LETTER = re.compile(r"[^\W\d_]")
_TO_SPACE = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def has_letter(text: str) -> bool:
    return any(unicodedata.category(m[0])[0] == "L" for m in _LETTER.finditer(text))


def _counts(text: str) -> np.ndarray:
    """How often each bucket's n-grams stand in the text."""
    out = np.zeros(BUCKETS, np.float64)
    raw = b" " + b" ".join(text.lower().encode(errors="replace").translate(_TO_SPACE).split()) + b" "
    for lo in range(0, len(raw), _PART):
        a = np.frombuffer(raw, np.uint8, count=min(_PART + 2, len(raw) - lo), offset=lo).astype(np.uint32)
        n = min(_PART, len(a))
        grams = a[:n], a[: len(a) - 1][:n] | (a[1:][:n] << 8) | 1 << 24, a[: len(a) - 2][:n] | (a[1:-1][:n] << 8) | (a[2:][:n] << 16) | 2 << 24
        for g in grams:
            out += np.bincount((g * np.uint32(2654435761)) >> np.uint32(32 - 13), minlength=BUCKETS)
    return out


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # a row for each centroid
    owner: np.ndarray  # the language of each row

    def vectors(self, texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), BUCKETS), np.float32)
        for i, t in enumerate(texts):
            x[i] = np.log1p(_counts(t)) * self.idf
        return _normal(x)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The nearest centroid's language and the cosine."""
        cosines = self.vectors(texts) @ self.centroids.T
        best = cosines.argmax(axis=1)
        return [self.languages[self.owner[k]] for k in best], np.clip(cosines[np.arange(len(texts)), best], 0, 1).astype(np.float64)


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids by spherical k-means, begun with the mean and then always the worst served vector."""
    chosen = [x.mean(axis=0)]
    while len(chosen) < min(k, len(x)):
        chosen.append(x[(x @ _normal(np.array(chosen)).T).max(axis=1).argmin()])
    c = _normal(np.array(chosen))
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(axis=1)
        c = _normal(np.array([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))]))
    return c


def _sample(known: DataFrame) -> DataFrame:
    """lang, doc_id, mark of at most TRAIN_ROWS different rows of each language.

    A share of each language's rows, by hash, of four times as many as are wanted is ranked, so that no
    task gets more of a language, however many rows it has."""
    rows = stash(known.select("lang", "doc_id", F.xxhash64("text").alias("mark")).distinct())
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    some = rows.join(sizes, "lang").where(F.pmod(F.xxhash64("doc_id", "mark"), "n") < 4 * TRAIN_ROWS)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "mark"))
    return some.withColumn("place", place).where(F.col("place") <= TRAIN_ROWS).select("lang", "doc_id", "mark")


def train(docs: DataFrame, usable: Column) -> Model | None:
    """Fit on a bounded sample of the usable rows. Their counts are taken on the executors."""
    known = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")

    def sparse(batches):
        for batch in batches:
            langs, texts = batch.column(0), batch.column(1).to_pylist()
            keep = [i for i, t in enumerate(texts) if has_letter(t)]
            counts = [_counts(texts[i]) for i in keep]
            at = [np.flatnonzero(c) for c in counts]
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(keep, pa.int64())), pa.array([a.astype("<i4").tobytes() for a in at], pa.binary()), pa.array([c[a].astype("<f4").tobytes() for c, a in zip(counts, at)], pa.binary())],
                names=["lang", "at", "n"],
            )

    marked = known.withColumn("mark", F.xxhash64("text"))
    chosen = F.broadcast(_sample(known).toDF("of", "of_id", "of_mark"))  # TRAIN_ROWS a language
    rows = marked.join(chosen, (F.col("lang") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("mark") == F.col("of_mark")), "left_semi")
    rows = rows.groupBy("lang", "doc_id", "mark").agg(F.min("text").alias("text")).select("lang", "text").mapInArrow(sparse, "lang string, at binary, n binary")
    rows = sorted(rows.collect(), key=lambda r: (r.lang, r.at, r.n))  # TRAIN_ROWS a language
    if not rows:
        return None
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r.at, "<i4")] = np.frombuffer(r.n, "<f4")
    langs = np.array([r.lang for r in rows])
    idf = (np.log((1 + len(rows)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    x = _normal(np.log1p(x) * idf)
    names = sorted(set(langs))
    parts = [_cluster(x[langs == n], CENTROIDS) for n in names]
    return Model(names, idf, np.concatenate(parts).astype(np.float32), np.repeat(np.arange(len(names)), [len(p) for p in parts]))


def identified(docs: DataFrame, model: Model | None, reject: float = REJECT) -> Column:
    """The struct lang_pred, score, rejected of each `text` of docs. Other columns do not leave the JVM."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # languages x CENTROIDS x BUCKETS floats

    def predicted(texts: pa.Array) -> pa.Array:
        m = held.value
        lang, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
        for lo in range(0, len(texts), _TEXTS_AT_ONCE):
            part = texts.slice(lo, _TEXTS_AT_ONCE).to_pylist()
            judged = [i for i, t in enumerate(part) if m and t and has_letter(t)]
            if judged:
                lang[lo + np.array(judged)], score[lo + np.array(judged)] = m.predict([part[i] for i in judged])
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array((lang == "und") | (1 - score > reject))], names=["lang_pred", "score", "rejected"])

    return F.arrow_udf(predicted, "lang_pred string, score double, rejected boolean")(F.col("text").cast("string"))


def held_out(doc_id: Column) -> Column:
    """Rows that training must not see; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: learnt from the rows that are not held out."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    found = docs.select("doc_id", identified(docs, train(docs, ~held_out(F.col("doc_id")))).alias("found"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "found.*")


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language is recognised."""
    found = identified(docs, train(docs, ~held_out(F.col("doc_id"))))
    return docs.where(~found["rejected"])
