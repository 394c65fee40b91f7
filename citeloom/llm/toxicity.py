"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives, any other texts are unlabelled. With class prior p and logistic loss, the risk
of a scorer is p * (loss of positives as positive) + max(0, loss of unlabelled as negative - p * loss of positives as
negative): the correction takes the hidden positives out of the unlabelled part, and the bound at 0 keeps a flexible
model from driving that estimate below what any labels could give. When a batch falls below it, the step goes the other
way on that part alone. The prior is the share of toxic rows among the labelled training rows, within limits.

Features are whether a text has certain words or pieces of words (word starts of 4 and 5 letters, inner runs of 5); the
FEATURES that tell the positives of the sample from its unlabelled texts best are taken. MODELS linear classifiers are
trained with numpy on the driver, from different seeds, and their mean is the score's logit.

The sample is bounded and documented: POSITIVES positives and UNLABELLED unlabelled texts, by the order of a digest of
id and text. Digests alone are sorted; those chosen are broadcast (POSITIVES + UNLABELLED at most) and their texts read
where they lie. Executors count features; the driver gets FEATURES counts and FEATURES / 8 bytes a text. Every text is
scored whole.

Defined results: null and empty texts have no feature and score as such; without positives or unlabelled texts to learn
from every score is 0. Repeated rows get equal scores. Columns named like a result are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drawn, written

POSITIVES, UNLABELLED, FEATURES, MODELS = 4_000, 12_000, 2_048, 3
EPOCHS, BATCH, RATE, DECAY = 60, 512, 0.02, 5e-5
#: A feature has to be so many times as often in positives as in unlabelled texts, and so many standard deviations more often.
RATIO, SURE = 2.5, 4.0
KEPT = 300_000


def pieces(word: str) -> set[str]:
    found = {"^" + word + "$"}
    if len(word) >= 4:
        found.add("^" + word[:4])
    if len(word) >= 5:
        found.add("^" + word[:5])
        found.update(word[i : i + 5] for i in range(len(word) - 4))
    return found


def features_of(text: str | None) -> set[str]:
    out: set[str] = set()
    for word in set((text or "").lower().split()):
        out |= pieces(word.strip(".,;:!?\"'()[]|"))
    return out


class Scorer:
    def __init__(self, names: list[str], weights: np.ndarray, bias: float):
        self.at = {n: i for i, n in enumerate(names)}
        self.weights, self.bias = weights, bias
        self.words: dict[str, tuple[int, ...]] = {}

    def found(self, text: str | None) -> set[int]:
        if not text:
            return set()
        words, at = self.words, self.at
        own = set(text.lower().split())
        if len(words) > KEPT:
            words.clear()
        for w in own.difference(words):
            words[w] = tuple(at[p] for p in pieces(w.strip(".,;:!?\"'()[]|")) if p in at)
        return set().union(*map(words.__getitem__, own))

    def __call__(self, text: str | None) -> float:
        found = self.found(text)
        logit = self.bias + (float(self.weights[sorted(found)].sum()) if found else 0.0)
        return float(1 / (1 + np.exp(-np.clip(logit, -40, 40))))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """The corrected risk of weights w on positives p and unlabelled u, its part of unlabelled texts as negatives before it is held at 0, and the direction of a step: the risk's gradient, or, where that part is below 0, the opposite of that part's."""
    zu, zp = u @ w, p @ w
    as_positive = prior * np.logaddexp(0, -zp).mean()
    as_negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    inner = u.T @ _sigmoid(zu) / len(u) - prior * (p.T @ _sigmoid(zp)) / len(p)
    step = prior * (p.T @ (_sigmoid(zp) - 1)) / len(p) + inner if as_negative >= 0 else -inner
    return as_positive + max(0.0, as_negative), as_negative, step


def train_one(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int) -> tuple[np.ndarray, float]:
    """Rows of packed bits -> weights and bias, by Adam on the corrected risk."""
    rng = np.random.default_rng(seed)
    width = positive.shape[1] * 8
    w = np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    view = lambda rows: np.concatenate([np.unpackbits(rows, axis=1), np.ones((len(rows), 1), np.uint8)], axis=1).astype(np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(unlabelled))
        for a in range(0, len(order), BATCH):
            u = view(unlabelled[order[a : a + BATCH]])
            p = view(positive[rng.integers(0, len(positive), min(len(positive), BATCH // 2))])
            g = risk(w, p, u, prior)[2]
            g[:-1] += DECAY * w[:-1]
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def train(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Scorer:
    """df: texts to learn from; labels(key, label): 1 for confirmed ones. Rows of labels with a null are left out."""
    told = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).where("_k IS NOT NULL AND _y IS NOT NULL").groupBy("_k").agg(F.max("_y").alias("_y"))
    labelled = told.agg(F.avg((F.col("_y") == 1).cast("double")).alias("share"), F.count_if(F.col("_y") == 1).alias("n")).first()
    prior = float(np.clip(labelled.share or 0.0, 0.01, 0.5))
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.xxhash64(text).cast("string")))
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("text"), digest.alias("at"))
    known = written(rows.select("_key", "at"), "toxicity-ids")  # no text goes further than this
    positive = known.join(told.where("_y = 1"), F.col("_key") == F.col("_k"), "left_semi").where(drawn(F.col("at"), POSITIVES, F.lit(labelled.n)))
    unlabelled = known.where(drawn(F.col("at"), UNLABELLED, F.lit(known.count())))
    chosen = [(r.at, kind) for some, most, kind in ((positive, POSITIVES, True), (unlabelled, UNLABELLED, False)) for r in some.select("at").distinct().orderBy("at").limit(most).collect()]
    named = df.sparkSession.createDataFrame(chosen, "at string, pos boolean")
    # rows repeated wholly count once: they are brought together before they are sent
    sample = rows.join(F.broadcast(named), "at").groupBy("at", "pos").agg(F.min("text").alias("text"))
    sample = written(sample.select("text", "pos"), "toxicity-sample")

    def count(batches):
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for t, p in zip(batch.column("text").to_pylist(), batch.column("pos").to_pylist()):
                for f in features_of(t):
                    seen.setdefault(f, [0, 0])[0 if p else 1] += 1
            if len(seen) > 200_000:
                yield _counts(seen)
                seen = {}
        yield _counts(seen)

    totals = sample.groupBy("pos").count().collect()
    n = {r.pos: r["count"] for r in totals}
    if not n.get(True) or not n.get(False):
        return Scorer([], np.zeros(0), -40.0)
    counts = sample.mapInArrow(count, "name string, p long, u long").groupBy("name").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    rate = (F.col("p") + 0.5) / (n[True] + 1.0), (F.col("u") + 0.5) / (n[False] + 1.0)
    gain = F.col("p") * F.log(rate[0] / rate[1])
    chance = n[True] * rate[1]
    counts = counts.where((rate[0] >= RATIO * rate[1]) & (F.col("p") - chance >= SURE * F.sqrt(chance + 1)))
    names = [r.name for r in counts.orderBy(F.desc(gain), "name").limit(FEATURES).select("name").collect()]
    names += [f"\0{i}" for i in range(-len(names) % 8)]

    def pack(batches):
        scorer = Scorer(names, np.zeros(len(names)), 0.0)
        for batch in batches:
            bits = np.zeros((batch.num_rows, len(names)), bool)
            for row, t in zip(bits, batch.column("text").to_pylist()):
                row[list(scorer.found(t))] = True
            yield pa.RecordBatch.from_arrays([batch.column("pos"), pa.array([r.tobytes() for r in np.packbits(bits, axis=1)], pa.binary())], ["pos", "bits"])

    got = sample.mapInArrow(pack, "pos boolean, bits binary").toArrow()  # POSITIVES + UNLABELLED rows at most
    got = sorted(zip(got.column("pos").to_pylist(), got.column("bits").to_pylist()))
    is_pos = np.array([p for p, _ in got], bool)
    bits = np.frombuffer(b"".join(b for _, b in got), np.uint8).reshape(len(is_pos), -1)
    models = [train_one(bits[is_pos], bits[~is_pos], prior, seed) for seed in range(MODELS)]
    return Scorer(names, np.mean([w for w, _ in models], axis=0), float(np.mean([b for _, b in models])))


def _counts(seen: dict) -> pa.RecordBatch:
    names = list(seen)
    return pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "p": pa.array([seen[f][0] for f in names], pa.int64()), "u": pa.array([seen[f][1] for f in names], pa.int64())})


def score(df: DataFrame, scorer: Scorer, text: str = "text") -> DataFrame:
    """df with score and predicted."""
    made = ("score", "predicted")
    keep = [c for c in df.columns if c not in made]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    told = df.sparkSession.sparkContext.broadcast((list(scorer.at), scorer.weights, scorer.bias))  # FEATURES names and numbers

    def run(batches):
        own = Scorer(*told.value)
        for batch in batches:
            s = [own(t.as_py()) for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], [*keep, *made])

    return df.select(*keep).mapInArrow(run, schema)
