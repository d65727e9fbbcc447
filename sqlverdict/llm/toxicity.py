"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; texts drawn without their labels are the unlabelled. A linear classifier g
is trained to the least class-prior-corrected risk

    prior * E_pos[loss(g)] + max(0, E_unl[loss(-g)] - prior * E_pos[loss(-g)])

where the second term estimates the risk on the negatives; when a step would drive it below zero the gradient is
taken the other way (the non-negative correction). The prior is the share of toxic among the labelled training rows.

The features are the presence of words and of their first bytes (inflected and compound forms share them), hashed;
those kept are significantly more frequent in the positives than in the unlabelled. How many documents have a feature
is counted over all training documents. The risk is minimised on a sample: at most POSITIVES confirmed and UNLABELLED
other documents, chosen by a hash of their ids, and the FEATURES most significant features (parameters of fit), so what
the driver holds is bounded in bytes whatever the length of the texts. Every whole text is scored, with work linear in
its bytes.

Defined cases: a null or empty text has no features and scores by the intercept; without any positive example
every score is 0; a null id is never held out nor learnt from; repeated rows score alike; only id and text of
documents and id and toxic of labels are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlverdict.llm import _bytes as B
from sqlverdict.llm._spark import dropped, fold_of, load, prepare, unused, written

POSITIVES, UNLABELLED, FEATURES = 3000, 9000, 4096
BITS = 20
MASK = (1 << BITS) - 1
HEADS = (4, 5, 6)
#: Bytes of text worked on at a time: a worker keeps what it needed for the longest piece while later stages run.
PIECE = 1 << 19
#: A feature is kept if positives have it so many times, and so many standard deviations, more often than unlabelled texts.
LIFT, SIGMAS = 3.0, 4.0
THRESHOLD = 0.3
#: ASCII letters and all bytes of other letters.
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
SPACED = np.where(LETTER, B.LOWER, 0x20).astype(np.uint8)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of texts: (index of the text, feature), with repetitions."""
    data = SPACED[data]
    starts, ends, counts = B.words(data, offsets)
    p, doc = B.prefix(data), B.spread(counts)
    shift = np.uint64(64 - BITS)
    found = [B.ranges(p, starts, ends) >> shift]
    for k in HEADS:
        found.append(B.mix(B.ranges(p, starts, np.minimum(starts + k, ends)) + np.uint64(k)) >> shift)
    return np.tile(doc, len(found)), np.concatenate(found).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray  # by feature, mostly 0
    intercept: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        doc, feature = features(data, offsets)
        some = self.weights[feature] != 0
        pair = B.distinct(doc[some] << BITS | feature[some])  # presence, not count
        g = np.bincount(pair >> BITS, self.weights[pair & MASK], len(offsets) - 1)
        return 1 / (1 + np.exp(-(g + self.intercept)))


def key_of(features: np.ndarray) -> tuple[int, ...]:
    """Three minima of hashed features, which tell a document's copies."""
    hashed = features.astype(np.uint64) * np.uint64(2)
    return tuple(int(B.mix(hashed + (np.uint64(s) << np.uint64(32))).min()) >> 1 if len(features) else 0 for s in (0x9E37, 0x79B9, 0x7F4A))


def apart(docs: list[np.ndarray]) -> list[np.ndarray]:
    """One of each group of copies: copies would count as evidence again."""
    return list({key_of(d): d for d in docs}.values())


def telling(df_p: np.ndarray, n_p: int, df_u: np.ndarray, n_u: int, most: int = FEATURES) -> np.ndarray:
    """The features that tell positives: how many of n_p positives and of n_u unlabelled documents have each."""
    expected = df_u * (n_p / n_u)
    sigmas = (df_p - expected) / np.sqrt(expected + 1)
    kept = np.flatnonzero((df_p >= 3) & (df_p >= LIFT * expected) & (sigmas >= SIGMAS))
    return np.sort(kept[np.argsort(-sigmas[kept], kind="stable")[:most]])


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -40, 40)))


def slopes(gp: np.ndarray, gu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """What a step descends by, as derivatives to the value of g at each positive and each unlabelled document.

    They are those of the whole risk or, where the estimated risk on the negatives is below zero, of its opposite.
    """
    sp, su = _sigmoid(gp), _sigmoid(gu)
    on_negatives = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    p, u = -prior * sp / len(gp), su / len(gu)
    return (prior * (sp - 1) / len(gp) + p, u) if on_negatives >= 0 else (-p, -u)


def minimised(positive: list[np.ndarray], unlabelled: list[np.ndarray], kept: np.ndarray, prior: float, steps: int = 400, rate: float = 0.1, l2: float = 1e-3) -> Model:
    """Fit the weights of the kept features by Adam on the non-negative risk."""
    n_p, n_u = len(positive), len(unlabelled)
    weights = np.zeros(1 << BITS)
    if not n_p or not n_u or not 0 < prior < 1:
        return Model(weights, -40.0 if not n_p or prior <= 0 else 40.0)
    place = np.full(1 << BITS, -1)
    place[kept] = np.arange(len(kept))

    def rows(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        col = place[np.concatenate([*docs, np.zeros(0, np.int64)]).astype(np.int64)]
        return at[col >= 0], col[col >= 0]

    (pr, pc), (ur, uc) = rows(positive), rows(unlabelled)
    w = np.zeros(len(kept) + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)

    def gradient(r: np.ndarray, c: np.ndarray, slope: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(c, slope[r], len(kept)), slope.sum())

    for t in range(1, steps + 1):
        sp, su = slopes(np.bincount(pr, w[pc], n_p) + w[-1], np.bincount(ur, w[uc], n_u) + w[-1], prior)
        d = gradient(pr, pc, sp) + gradient(ur, uc, su)
        d[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * d, 0.999 * v + 0.001 * d * d
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights[kept] = w[:-1]
    return Model(weights, float(w[-1]))


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """A model of documents at hand; each is the array of its distinct features."""
    positive, unlabelled = apart(positive), apart(unlabelled)
    df_p, df_u = (np.bincount(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64), minlength=1 << BITS) for x in (positive, unlabelled))
    kept = telling(df_p, len(positive), df_u, max(1, len(unlabelled)))
    return minimised(positive, unlabelled, kept, prior)


def _frequencies(docs: DataFrame, text_col: str, wanted: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """In how many documents each (wanted) feature is, and the number of documents."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << BITS, np.int64), 0
        use = np.ones(1 << BITS, bool) if sent.value is None else np.isin(np.arange(1 << BITS), sent.value)
        for part, data, offsets in B.chunks(batches, limit=PIECE):
            doc, feature = features(data, offsets)
            some = use[feature]
            pair = B.distinct(doc[some] << BITS | feature[some])
            total += np.bincount(pair & MASK, minlength=1 << BITS)
            n += part.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(total[some], n))], ["f", "n"])

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "f int, n bigint")
    # one row a feature, at most 2^BITS of them
    found = counted.groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    f, n = found.column("f").to_numpy(), found.column("n").to_numpy()
    total = np.zeros(1 << BITS, np.int64)
    total[f[f >= 0]] = n[f >= 0]
    return total, int(n[f < 0].sum())


def _apart(docs: DataFrame, text_col: str) -> DataFrame:
    """text: one of each group of copies."""
    keys = ["k1", "k2", "k3"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in B.chunks(batches, limit=PIECE):
            doc, feature = features(data, offsets)
            at = np.searchsorted(order := np.sort(doc << BITS | feature), np.arange(part.num_rows + 1) << BITS)
            found = np.array([key_of(order[a:b] & MASK) for a, b in zip(at[:-1], at[1:], strict=True)], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*[pa.array(found[:, k]) for k in range(3)], part.column("text")], [*keys, "text"])

    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(run, "k1 bigint, k2 bigint, k3 bigint, text string")
    return rows.groupBy(*keys).agg(F.min("text").alias("text")).select("text")


def _features(docs: DataFrame, kept: np.ndarray, most: int) -> list[np.ndarray]:
    """The kept features of each document, at most as many documents as were asked for (repeated ids may bring more)."""
    sent = docs.sparkSession.sparkContext.broadcast(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = np.isin(np.arange(1 << BITS), sent.value)
        for part, data, offsets in B.chunks(batches, limit=PIECE):
            doc, feature = features(data, offsets)
            some = use[feature]
            pair = B.distinct(doc[some] << BITS | feature[some])
            at = np.searchsorted(pair, np.arange(part.num_rows + 1) << BITS)
            found = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array((pair & MASK).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(B.ranges(B.prefix(data), offsets[:-1], offsets[1:]).view(np.int64)), found], ["h", "f"])

    found = docs.mapInArrow(run, "h bigint, f array<int>").orderBy("h").limit(most).toArrow().column("f")
    # views of Arrow's own arrays: a Python list of the numbers would take many times their size
    return [part.values.to_numpy()[a:b] for part in found.chunks for a, b in zip(part.offsets.to_numpy()[:-1].tolist(), part.offsets.to_numpy()[1:].tolist(), strict=True)]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED, most_features: int = FEATURES) -> Model:
    """A model of bounded samples and of the features' counts in all training documents; held-out labels are not read."""
    prepare(docs.sparkSession)
    seen = ~(fold_of(id_col, 4) == 2 if held_out is None else held_out)
    own = unused("llm_id", tuple(docs.columns))
    known = labels.where(seen & F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).select(F.col(id_col).alias(own), (F.col("toxic") == 1).alias("toxic"))
    share = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    if not share:
        return Model(np.zeros(1 << BITS), -40.0)
    order = F.xxhash64(own)
    training = docs.where(seen & F.col(id_col).isNotNull())
    drawn = training.select(F.col(id_col).alias(own))
    # both sides are limited by the parameters above, so they may be sent to all executors
    sample = lambda ids, n: F.broadcast(ids.distinct().orderBy(order, own).limit(n))
    texts = lambda ids, n: written(_apart(docs.join(sample(ids, n), F.col(id_col) == F.col(own), "left_semi"), text_col), "toxicity")
    toxic, others = texts(known.where("toxic").select(own), positives), texts(drawn, unlabelled)
    df_p, n_p = _frequencies(toxic, "text")
    df_u, n_u = _frequencies(training, text_col, np.flatnonzero(df_p >= 3))
    kept = telling(df_p, n_p, df_u, max(1, n_u), most_features)
    model = minimised(_features(toxic, kept, positives), _features(others, kept, unlabelled), kept, share)
    dropped(docs.sparkSession, toxic, others)
    return model


def score(docs: DataFrame, model: Model, name: str = "score", text_col: str = "text") -> DataFrame:
    """docs with a score from 0 to 1 of each whole text."""
    prepare(docs.sparkSession)
    packed = docs.sparkSession.sparkContext.broadcast((np.flatnonzero(model.weights), model.weights[np.flatnonzero(model.weights)], model.intercept))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, value, intercept = packed.value
        weights = np.zeros(1 << BITS)
        weights[where] = value
        own = Model(weights, intercept)
        for part in batches:
            column = part.column(at)
            text = column if pa.types.is_string(column.type) else column.cast(pa.string())
            found = [own.scores(data, offsets) for _, data, offsets in B.chunks(iter([pa.RecordBatch.from_arrays([text], ["text"])]), limit=PIECE)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.concatenate([*found, np.zeros(0)]))], [*part.schema.names, name])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with a score under the threshold."""
    name = unused("llm_score", tuple(docs.columns))
    return score(docs, fit(docs, labels, id_col, text_col), name, text_col).where(F.col(name) < THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, load(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
