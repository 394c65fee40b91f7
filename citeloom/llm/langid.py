"""Language identification by a blended-spectrum string kernel, Nyström landmarks and kernel ridge regression.

A text's features are which hashed n-grams of 2 to 4 bytes (letters A-Z lower-cased) occur in it; the kernel is the
number of features two texts share over the root of the product of their numbers of features. Landmarks are training
texts; their kernel matrix gives Nyström features, in which one ridge regression for each language tells it from the
rest. A score is then (shared features with each landmark) times coefficients, and as the kernel is linear in the
features, landmarks and coefficients are multiplied once: batches are scored by one matrix product of features and
weights, however many landmarks there are.

The model is fitted on the driver on a bounded sample: PER_CLASS texts of each language, by the order of their id's
digest, of the TRAIN most frequent languages, and TRAIN texts in all; executors send features (BUCKETS / 8 bytes a text), never texts. Landmarks are the
first LANDMARKS of them in that order.

Defined results: `und` and score 0 for a null text or one without a letter; a text too short for any n-gram scores 0
for every language and gets the first by name; if no language can be learned all is `und`. Ties go to the first
language by name. Whole texts are read. Repeated rows get equal results; columns named like a result are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drawn

#: Hash buckets of the features, bounds of the sample, landmarks, and the ridge.
BUCKETS, PER_CLASS, TRAIN, LANDMARKS, RIDGE = 1 << 15, 400, 3000, 400, 0.05
BATCH = 64
#: A text that scores less for every language is none of them: its n-grams speak against each as much as for it.
LEAST_SCORE = 0.05
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


def marks(texts: list[str | None]) -> np.ndarray:
    """Presence of each bucket in each text, as float32."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    shift = np.uint32(32 - 15)
    for row, text in zip(out, texts):
        b = _LOWER[np.frombuffer((text or "").encode(), np.uint8)]
        h = b
        for n in (2, 3, 4):
            h = (h[:-1] << np.uint32(8)) | b[n - 1 :] if len(h) > 1 else h[:0]
            row[((h * np.uint32(2654435761)) ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(2246822519) >> shift] = 1
    return out


class Model:
    def __init__(self, names: list[str], weights: np.ndarray):
        self.names, self.weights = names, weights

    @staticmethod
    def fit(packed: np.ndarray, langs: list[str]) -> Model:
        """packed: rows of packed bits; the first of them are landmarks."""
        names = sorted(set(langs))
        if not names:
            return Model([], np.zeros((BUCKETS, 0), np.float32))
        unpack = lambda rows: np.unpackbits(rows, axis=1).astype(np.float32)
        marked = unpack(packed[:LANDMARKS])
        root = np.sqrt(np.maximum(marked.sum(1), 1))
        marked /= root[:, None]
        parts = []
        for a in range(0, len(packed), 256):
            x = unpack(packed[a : a + 256])
            parts.append(x @ marked.T / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1)))
        to_all = np.concatenate(parts).astype(np.float64)
        values, axes = np.linalg.eigh((marked @ marked.T).astype(np.float64))
        good = values > 1e-6 * values[-1]
        whiten = axes[:, good] / np.sqrt(values[good])
        z = to_all @ whiten
        goal = np.array([[x == n for n in names] for x in langs], np.float64)
        fitted = np.linalg.solve(z.T @ z + RIDGE * np.eye(z.shape[1]), z.T @ goal)
        return Model(names, (marked.T @ (whiten @ fitted)).astype(np.float32))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = marks(texts)
        return x @ self.weights / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def train(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Fits on rows whose text and lang aren't null. Samples in the order of a digest of the key."""
    rows = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("at"), F.col(text).alias("text"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(TRAIN)
    rows = rows.join(F.broadcast(sizes), "lang").where(drawn(F.col("at"), PER_CLASS, F.col("n")))  # TRAIN rows at most are broadcast
    order = Window.partitionBy("lang").orderBy("at", F.md5("text"))
    rows = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PER_CLASS)

    def pack(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH)
                bits = np.packbits(marks(part.column("text").to_pylist()).astype(bool), axis=1)
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("at"), part.column("place"), pa.array([r.tobytes() for r in bits], pa.binary())], ["lang", "at", "place", "bits"])

    rows = rows.mapInArrow(pack, "lang string, at string, place int, bits binary").orderBy("place", "lang", "at").limit(TRAIN)
    told = rows.toArrow()
    bits = np.frombuffer(b"".join(told.column("bits").to_pylist()), np.uint8).reshape(-1, BUCKETS // 8)
    return Model.fit(bits, told.column("lang").to_pylist())


def identified(df: DataFrame, model: Model, text: str = "text", lang: str = "lang", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of df, its columns only, whose language can be told, with the predicted one in lang: texts without a letter go, and those that score below `least` for every language learned."""
    rows = predict(df, model, text).where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return rows.withColumn(lang, F.col("lang_pred")).select(*df.columns)


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with lang_pred and score."""
    made = ("lang_pred", "score")
    keep = [c for c in df.columns if c not in made]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    told = df.sparkSession.sparkContext.broadcast((model.names, model.weights))  # BUCKETS x languages numbers
    lettered = df.select(*keep).withColumn("_lettered", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))

    def run(batches):
        own = Model(*told.value)
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH)
                good = np.array(part.column("_lettered").to_pylist(), bool)
                names, score = ["und"] * part.num_rows, np.zeros(part.num_rows)
                if own.names and good.any():
                    s = own.scores(part.column(text).to_pylist())
                    top = s.argmax(1)
                    names = [own.names[t] if g else "und" for t, g in zip(top, good)]
                    score = np.where(good, np.clip(s[np.arange(len(s)), top], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(names, pa.string()), pa.array(score, pa.float64())], [*keep, *made])

    return lettered.mapInArrow(run, schema)
