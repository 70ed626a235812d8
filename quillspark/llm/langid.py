"""Language identification with hyperdimensional n-gram profiles.

Every letter has a random vector of +1 and -1, drawn from a hash of its code point; anything else separates words. A
trigram's vector is the product of its letters' vectors, the first rotated twice, the second once; a text's vector is
the sum over its trigrams, and a language's prototype the sum of its training texts' unit vectors. The prediction is
the prototype with the largest cosine, ties going to the smaller name. Texts that are null or have no letter are `und`
with score 0. Vectors of at most CACHE trigrams are kept at hand, which bounds memory for any script.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import mix64, small_batches, table

DIMENSIONS, PER_LANGUAGE = 512, 3000
#: Most trigrams whose vectors are kept, and how many are summed at a time.
CACHE, BLOCK = 1 << 17, 1 << 14
#: Bits of a code point in a trigram's number.
POINT = 21

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    """True at the code points of letters."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigram numbers of a text and their counts; none, if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _is_letter()[points]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.concatenate(([0], np.where(letter, points, 0), [0])).astype(np.int64)
    points = points[np.concatenate(([True], (points[1:] != 0) | (points[:-1] != 0)))]
    return np.unique(points[:-2] << 2 * POINT | points[1:-1] << POINT | points[2:], return_counts=True)


def letter_vectors(points: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 7) -> np.ndarray:
    """A row of +1 and -1 for each code point (0: what separates words)."""
    words = np.arange(-(-dimensions // 64), dtype=np.uint64) + np.uint64(seed << 32)
    start = mix64((points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    bits = mix64(start[:, None] + mix64(words * np.uint64(0xD1B54A32D192ED03)))
    return np.unpackbits(bits.view(np.uint8), axis=1)[:, :dimensions].astype(np.int8) * 2 - 1


class Encoder:
    """Text to hypervector, with the vectors of trigrams met so far at hand."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 7):
        self.dimensions, self.seed = dimensions, seed
        self.known = np.zeros((0, dimensions), np.int8)
        self._forget()

    def _forget(self) -> None:
        self.grams, self.place, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def _made(self, grams: np.ndarray) -> np.ndarray:
        mask = (1 << POINT) - 1
        points, which = np.unique(np.concatenate((grams >> 2 * POINT, grams >> POINT & mask, grams & mask)), return_inverse=True)
        a, b, c = which.reshape(3, -1)
        letters = letter_vectors(points, self.dimensions, self.seed)
        return np.roll(letters, 2, axis=1)[a] * np.roll(letters, 1, axis=1)[b] * letters[c]

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """One row for each trigram number (BLOCK distinct ones at most, ascending)."""
        at = np.searchsorted(self.grams, grams)
        new = np.ones(len(grams), bool)
        inside = at < self.size
        new[inside] = self.grams[at[inside]] != grams[inside]
        if new.any():
            if self.size + new.sum() > CACHE:
                self._forget()
                at, new = np.zeros(len(grams), np.int64), np.ones(len(grams), bool)
            fresh, end = grams[new], self.size + int(new.sum())
            if end > len(self.known):
                grown = np.zeros((min(CACHE, max(1024, 2 * end)), self.dimensions), np.int8)
                grown[: self.size] = self.known[: self.size]
                self.known = grown
            self.known[self.size : end] = self._made(fresh)
            self.grams, self.place = np.insert(self.grams, at[new], fresh), np.insert(self.place, at[new], np.arange(self.size, end))
            self.size = end
            at = np.searchsorted(self.grams, grams)
        return self.known[self.place[at]]

    def encode(self, text: str) -> np.ndarray | None:
        """The text's unit vector; None without letters."""
        grams, counts = trigrams(text)
        if not len(grams):
            return None
        total = np.zeros(self.dimensions, np.float32)
        for i in range(0, len(grams), BLOCK):
            total += counts[i : i + BLOCK].astype(np.float32) @ self.vectors(grams[i : i + BLOCK]).astype(np.float32)
        size = np.linalg.norm(total)
        return total / size if size else total


def train(labelled: DataFrame, text_col: str, lang_col: str, per_language: int = PER_LANGUAGE, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Language names, sorted, and their prototypes (unit rows).

    Learns from about per_language different texts of each language at most, picked by a hash of the text; copies of
    a picked text count once, so that a large group of copies neither outgrows the sample nor outweighs the language;
    nor do copies make the sample smaller, as its share is that of the different texts.
    What comes to the driver is one vector for each language.
    """
    known = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count_distinct(F.xxhash64("text")).alias("n")).collect()}
    if not sizes:
        return [], np.zeros((0, dimensions), np.float32)
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, per_language / n)))])
    sample = known.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).distinct()

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, sums = Encoder(dimensions), {}
        for frame in frames:
            for lang, text in zip(frame.lang, frame.text, strict=True):
                vector = encoder.encode(text)
                if vector is not None:
                    sums[lang] = sums.get(lang, 0) + np.rint(vector.astype(np.float64) * (1 << 20)).astype(np.int64)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "v": [x.tolist() for x in sums.values()]})

    parts = sample.mapInPandas(partial, "lang string, v array<long>").select("lang", F.posexplode("v").alias("i", "x"))
    rows = parts.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    found = sorted((r.lang, [e.x for e in r.v]) for r in rows.collect())
    prototypes = np.array([v for _, v in found], np.float64).reshape(len(found), dimensions)
    sizes_of = np.linalg.norm(prototypes, axis=1, keepdims=True)
    return [lang for lang, _ in found], (prototypes / np.where(sizes_of, sizes_of, 1)).astype(np.float32)


def predict(spark: SparkSession, docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """docs with lang_pred and score (the cosine, 0 if negative); only the text column is looked at."""
    names, prototypes = model
    shared = spark.sparkContext.broadcast((names, prototypes))

    @F.pandas_udf("lang_pred string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, prototypes = shared.value
        encoder = Encoder(dimensions)
        for batch in batches:
            langs, scores = [], []
            for text in batch:
                vector = encoder.encode(text) if text and names else None
                if vector is None:
                    langs.append("und")
                    scores.append(0.0)
                else:
                    cosines = prototypes @ vector
                    best = int(np.argmax(cosines))
                    langs.append(names[best])
                    scores.append(float(min(1.0, max(0.0, cosines[best]))))
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    judged = docs.withColumn("_judged", judge(F.col(text_col)))
    return judged.withColumn("lang_pred", F.col("_judged.lang_pred")).withColumn("score", F.col("_judged.score")).drop("_judged")


def held_out(id_col: Column) -> Column:
    """The fifth of the documents that training leaves out, by checksum of the id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """The model learnt from the documents that are not held out."""
    return train(docs.where(~held_out(F.col("doc_id"))), "text", "lang", per_language)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of all documents."""
    docs = table(spark, sf_dir, "documents")
    found = predict(spark, docs.select("doc_id", "text"), fit(docs.where("doc_id is not null")))  # a row without id has no remainder
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that have no letter in them; lang is what the text says where it was missing."""
    small_batches(spark)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    kept = predict(spark, whole, fit(docs)).where("lang_pred <> 'und'")
    return kept.select(*[F.coalesce("row.lang", "lang_pred").alias(c) if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns])


QUERIES = {"op3_language_id": op3_language_id}
ORACLES: dict[str, str] = {}
