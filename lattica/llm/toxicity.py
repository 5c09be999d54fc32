"""Toxicity: embeddings of a word's character n-grams, averaged over a window of words, into a linear softmax.

Vectors and softmax are trained jointly in numpy. A text scores as its worst window, so a few bad words in a long text
are not averaged away; in training, too, a toxic text is represented by its worst windows and a clean one must keep its
worst windows low. A new spelling shares most of its n-gram vectors with the spellings seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released, ship_package, slices

BUCKETS, WIDTH, WINDOW, STRIDE = 1 << 18, 8, 48, 24
GRAMS = (3, 4, 5, 6)
#: The fit's bounds: texts of each class, and characters of a text that may be one of them.
PER_CLASS, MOST_CHARS = 2000, 20_000
THRESHOLD = 0.7
#: Standard errors at which an n-gram's vector moves at half the rate, and the fewest texts of a class that calibrate.
HALF_SURE, CALIBRATE = 3.0, 50
MOST_KNOWN = 400_000
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams(distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each <word>, and where each word's begin (with the end)."""
    if not distinct:
        return np.empty(0, np.int32), np.zeros(1, np.int64)
    codes = np.frombuffer("".join([f"<{w}>" for w in distinct]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(distinct), dtype=np.int32), [len(w) + 2 for w in distinct])
    found, owner = [], []
    with np.errstate(over="ignore"):
        for n in GRAMS:
            if len(codes) < n:
                continue
            h = np.full(len(codes) - n + 1, np.uint64(n))
            for i in range(n):
                h = (h ^ codes[i : len(codes) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            inside = word[: len(h)] == word[n - 1 :]
            found.append((h[inside] >> np.uint64(40)).astype(np.int32) & (BUCKETS - 1))
            owner.append(word[: len(h)][inside])
    flat, of = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(of, kind="stable")
    return flat[order], np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(distinct)))])


def _means(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Means over consecutive runs; every run has a member."""
    return np.add.reduceat(values, starts[:-1], axis=0) / np.diff(starts).reshape(-1, *[1] * (values.ndim - 1))


def worst_window(scores: np.ndarray) -> float:
    """The greatest mean over WINDOW consecutive words, or over all where there are fewer; 0 for none."""
    if len(scores) <= WINDOW:
        return float(scores.mean()) if len(scores) else 0.0
    total = np.concatenate([[0.0], np.cumsum(scores)])
    return float((total[WINDOW:] - total[:-WINDOW]).max() / WINDOW)


@dataclass
class Model:
    """The difference of the two logits: a number per n-gram bucket, averaged, and the bias."""

    gram: np.ndarray
    bias: float

    def of_words(self, distinct: list[str]) -> np.ndarray:
        flat, starts = grams(distinct)
        return _means(self.gram[flat].astype(np.float64), starts) if distinct else np.empty(0)


def _trust(sequences: list[np.ndarray], flat: np.ndarray, starts: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How fast each bucket's vector moves (0 to 1), and the log odds that it starts from.

    The share of toxic texts that hold an n-gram is compared with that of clean ones: the more standard errors lie
    between them, the faster its vector moves, along a logistic curve. This damps what a rare n-gram learns from the
    few texts that happen to hold it; none is frozen.
    """
    holds = np.zeros((2, BUCKETS))
    for s, y in zip(sequences, toxic, strict=True):
        distinct = np.unique(s)
        if len(distinct):
            holds[y, np.unique(np.concatenate([flat[starts[i] : starts[i + 1]] for i in distinct]))] += 1
    n = np.bincount(toxic, minlength=2)
    clean, bad = holds[0] / n[0], holds[1] / n[1]
    both = holds.sum(0) / n.sum()
    z = (bad - clean) / np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n[0] + 1 / n[1]))
    trust = 1 / (1 + np.exp(-3 * (np.abs(z) - HALF_SURE)))
    odds = np.log((holds[1] + 0.5) / (n[1] + 1)) - np.log((holds[0] + 0.5) / (n[0] + 1))
    return trust, trust * np.maximum(odds, 0.0)


def train(texts: list[str], toxic: np.ndarray, seed: int = 7, **how) -> Model:
    """Fits n-gram vectors and softmax, and calibrates the score where each class has 2 x CALIBRATE texts.

    Copies of a text count once: they would make chance n-grams look telling. To calibrate, each half of the texts is
    scored by a model of the other half; a logistic curve through these scores gives the scale and the bias.
    """
    first = {t: i for i, t in reversed(list(enumerate(texts)))}
    texts, toxic = [texts[i] for i in sorted(first.values())], np.asarray(toxic, int)[sorted(first.values())]
    if not len(texts) or toxic.min() == toxic.max():
        return Model(np.zeros(BUCKETS, np.float32), -20.0 if not len(texts) or not toxic.max() else 20.0)
    model = _train(texts, toxic, seed, **how)
    if np.bincount(toxic).min() < 2 * CALIBRATE:
        return model
    half = np.empty(len(texts), int)
    for y in (0, 1):
        half[toxic == y] = np.random.default_rng(seed).permutation((toxic == y).sum()) % 2
    logits = np.empty(len(texts))
    for h in (0, 1):
        other = np.flatnonzero(half != h)
        scorer = _Scorer(_train([texts[i] for i in other], toxic[other], seed, **how))
        logits[half == h] = scorer.logits([texts[i] for i in np.flatnonzero(half == h)])
    scale, bias = _logistic(logits, toxic)
    return Model((model.gram * scale).astype(np.float32), model.bias * scale + bias)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and bias of a logistic curve, by Newton's method, drawn weakly towards (1, 0)."""
    given, at = np.stack([x, np.ones(len(x))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(given @ at, -30, 30)))
        slope = given.T @ (p - y) + (at - [1.0, 0.0])
        bend = (given * (p * (1 - p))[:, None]).T @ given + np.eye(2)
        at = at - np.clip(np.linalg.solve(bend, slope), -0.5, 0.5)
    return float(np.clip(at[0], 0.2, 5)), float(at[1])


def _train(texts: list[str], toxic: np.ndarray, seed: int, least_steps: int = 250, batch: int = 128, rate: float = 0.3) -> Model:
    """Jointly fits all n-gram vectors (unseen ones stay neutral, at 0) and the softmax over them, by Adagrad. Texts without
    words teach nothing; if all are such, every score is one half."""
    rng = np.random.default_rng(seed)
    index: dict[str, int] = {}
    sequences = [np.array([index.setdefault(w, len(index)) for w in words(t)], np.int32) for t in texts]
    if not index:  # no word to learn from: what is left is the bias, even as both classes weigh the same
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    flat, starts = grams(list(index))
    trust, start = _trust(sequences, flat, starts, toxic)
    begins, spans, owner = [], [], []
    offsets = np.cumsum([0, *map(len, sequences)])
    for d, s in enumerate(sequences):
        for at in range(0, max(1, len(s) - WINDOW + STRIDE), STRIDE) if len(s) else ():
            n = min(WINDOW, len(s) - at)
            begins.append(offsets[d] + at), spans.append(n), owner.append(d)
    tokens = np.concatenate(sequences)
    begins, spans, owner = np.array(begins), np.array(spans), np.array(owner)
    w = rng.normal(0, 1, (2, WIDTH)).astype(np.float32)
    way = w[1] - w[0]
    e = (start[:, None] * way[None, :] / (way @ way)).astype(np.float32)  # the logits differ by `start`
    b = np.zeros(2, np.float32)
    ge, gw, gb = np.full_like(e, 1e-6), np.full_like(w, 1e-6), np.full_like(b, 1e-6)
    share = np.bincount(toxic, minlength=2) / len(toxic)

    def step(rows: np.ndarray, rate: float) -> None:
        at = np.repeat(begins[rows], spans[rows]) + np.concatenate([np.arange(n) for n in spans[rows]])
        distinct, place = np.unique(tokens[at], return_inverse=True)
        counts = (starts[distinct + 1] - starts[distinct]).astype(np.int64)
        gram_at = np.repeat(starts[distinct], counts) + (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
        ids, ends = flat[gram_at], np.concatenate([[0], np.cumsum(counts)])
        vectors = _means(e[ids], ends)
        edges = np.concatenate([[0], np.cumsum(spans[rows])])
        bag = _means(vectors[place], edges)
        logits = np.einsum("ij,kj->ik", bag, w) + b
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        y = toxic[owner[rows]]
        p[np.arange(len(rows)), y] -= 1
        p *= (0.5 / share[y])[:, None] / len(rows)
        dw, db, dbag = np.einsum("ij,ik->jk", p, bag), p.sum(0), np.einsum("ij,jk->ik", p, w)
        per_token = np.repeat(dbag / spans[rows][:, None], spans[rows], axis=0)
        dv = np.stack([np.bincount(place, per_token[:, k], len(distinct)) for k in range(WIDTH)], 1) / counts[:, None]
        spread = np.repeat(dv, counts, axis=0)
        used, where = np.unique(ids, return_inverse=True)
        de = np.stack([np.bincount(where, spread[:, k], len(used)) for k in range(WIDTH)], 1).astype(np.float32)
        ge[used] += de * de
        e[used] -= (rate * trust[used][:, None] * de / np.sqrt(ge[used])).astype(np.float32)
        gw[:] += dw * dw
        w[:] -= rate * 0.2 * dw / np.sqrt(gw)
        gb[:] += db * db
        b[:] -= rate * 0.2 * db / np.sqrt(gb)

    by_doc = np.searchsorted(owner, np.arange(len(texts) + 1))
    done, epoch = 0, 0
    while done < least_steps or epoch < 4:
        score = _means(np.einsum("ij,j->i", e, w[1] - w[0])[flat], starts)[tokens]
        total = np.concatenate([[0.0], np.cumsum(score, dtype=np.float64)])
        level = (total[begins + spans] - total[begins]) / spans
        chosen = []
        for d in range(len(texts)):
            rows = np.arange(by_doc[d], by_doc[d + 1])
            if len(rows) > 6:
                if epoch < 2:
                    rows = rng.choice(rows, 6, replace=False)
                else:
                    rows = rows[np.argsort(-level[rows], kind="stable")]
                    rows = rows[:2] if toxic[d] else np.concatenate([rows[:4], rng.choice(rows[4:], 2, replace=False)])
            elif epoch >= 2 and toxic[d] and len(rows):
                rows = rows[np.argsort(-level[rows], kind="stable")][:1]
            chosen.append(rows)
        order = rng.permutation(np.concatenate(chosen))
        for at in range(0, len(order), batch):
            step(order[at : at + batch], rate)
            done += 1
        epoch += 1
    return Model(np.einsum("ij,j->i", e, w[1] - w[0]).astype(np.float32), float(b[1] - b[0]))


def held_out(key: Column) -> Column:
    """Rows whose labels no fit may see."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = PER_CLASS, most_chars: int = MOST_CHARS) -> Model:
    """Learns from at most per_class texts of each class, of at most most_chars characters each, picked by a hash of the key.

    Held-out rows and null labels take no part; a key labelled twice is toxic if one label is, and rows that share a
    key give one text. Without both classes every score is about 0 (or about 1, if all are toxic).
    """
    spark = docs.sparkSession
    marked = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("toxic")).where(~held_out(F.col("key")) & F.col("toxic").isNotNull()).groupBy("key").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    picks = []
    for value in (0, 1):  # each at most per_class ids; a quarter more, as some texts may be missing or too long
        mine = marked.where(F.col("toxic") == value).orderBy(F.xxhash64("key", F.lit(11)), "key").limit(per_class * 5 // 4)
        picks += [(r.key, r.toxic) for r in mine.collect()]
    if not picks:
        return train([], np.empty(0))
    wanted = F.broadcast(spark.createDataFrame(picks, f"key {dict(marked.dtypes)['key']}, toxic int"))
    # rows that share a key are one text, so that copies of one key can't fill the sample
    rows = texts.join(wanted, "key").where(F.char_length("text") <= most_chars).groupBy("key", "toxic").agg(F.min("text").alias("text"))
    rows = rows.orderBy(F.xxhash64("key", F.lit(11)), "key").collect()  # of the keys picked above
    rows = [r for v in (0, 1) for r in [x for x in rows if x.toxic == v][:per_class]]
    return train([r.text for r in rows], np.array([r.toxic for r in rows]))


class _Scorer:
    """Scores texts; remembers the words of a task."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def logits(self, texts: list[str | None]) -> np.ndarray:
        found = [words(x) for x in texts]
        if len(self.known) > MOST_KNOWN:
            self.known.clear()
        fresh = [w for w in {w for f in found for w in f} if w not in self.known]
        for at in range(0, len(fresh), 20_000):
            part = fresh[at : at + 20_000]
            self.known.update(zip(part, self.model.of_words(part).tolist(), strict=True))
        return np.array([worst_window(np.fromiter(map(self.known.__getitem__, f), float, len(f))) for f in found]) + self.model.bias

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -50, 50)))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score (0 to 1) of each whole text; only the text matters. Null and empty texts score as the bias alone.

    Repeated rows are scored one by one; a very long text is one task's work, in time in proportion to its words.
    """
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(model)  # a number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(sent.value)
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(scorer(batch.column("text").to_pylist()))], ["key", "score"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(released(run), f"key {kind}, score double").withColumnRenamed("key", key)


def keep_clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose text scores below the threshold."""
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(sent.value)
        for batch in slices(batches, text):
            yield batch.filter(pa.array(scorer(batch.column(text).to_pylist()) < threshold))

    return docs.mapInArrow(released(run), docs.schema)
