"""Quality classifier: Naive Bayes support vectors.

A text's features are indicators of its hashed word n-grams. Each is scaled by its log-count ratio between the classes;
a linear hinge-loss model on the scaled indicators is fitted by dual coordinate descent and calibrated on rows that the
fit has not seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.llm.bpe import slices
from offerlake.llm.common import MULTIPLIER, extended, fold, mixed, tidy

BUCKETS = 1 << 18
TRAINING_ROWS = 8000  # labelled rows that the classifier is fitted on, at most
CALIBRATION = 5  # one in so many of them calibrates
COST, PASSES = 1.0, 12  # cost of a row's loss where both classes are equally frequent
THRESHOLD = 0.3

TOKEN = re.compile(r"\w+|[^\w\s]+")


def hashed(token: str) -> int:
    h = 0xCBF29CE484222325
    for b in token.lower().encode("utf-8", "surrogatepass"):
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


class Tokens:
    """Token hashes, kept for a task up to a bound."""

    def __init__(self, bound: int = 300_000):
        self.bound, self.known = bound, {}

    def of(self, text: str) -> list[int]:
        known = self.known
        if len(known) > self.bound:
            known.clear()
        found = TOKEN.findall(text)
        try:
            return [known[w] for w in found]
        except KeyError:
            for w in found:
                if w not in known:
                    known[w] = hashed(w)
            return [known[w] for w in found]


def features(texts: list[str], tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each text, text after text, and where each text begins (one more at the end).

    One-, two- and three-grams; a token that repeats the one before it gives one common feature instead of its
    bigram, so that repetition counts whatever is repeated.
    """
    lists = [tokens.of(t) for t in texts]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    h = np.fromiter((x for own in lists for x in own), np.uint64, int(sizes.sum()))
    row = np.repeat(np.arange(len(texts)), sizes)
    one = mixed(h)
    two = mixed(h[:-1] * MULTIPLIER + h[1:])
    two[h[:-1] == h[1:]] = np.uint64(12345)
    three = mixed((h[:-2] * MULTIPLIER + h[1:-1]) * MULTIPLIER + h[2:]) if len(h) > 2 else h[:0]
    within2, within3 = row[:-1] == row[1:], row[:-2] == row[2:]
    key = np.concatenate([row * BUCKETS + (one >> np.uint64(46)).astype(np.int64), (row[:-1] * BUCKETS + (two >> np.uint64(46)).astype(np.int64))[within2], (row[:-2] * BUCKETS + (three >> np.uint64(46)).astype(np.int64))[within3]])
    key = np.unique(key)
    return (key % BUCKETS).astype(np.int32), np.searchsorted(key, np.arange(len(texts) + 1) * BUCKETS)


def log_ratios(found: np.ndarray, begins: np.ndarray, labels: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """By bucket: logarithm of the share of rows with label 1 that hold it over the share of the others, counts plus one."""
    good = labels > 0
    of_good = np.repeat(good, np.diff(begins))
    up, down = (np.bincount(found[x], minlength=buckets) + 1.0 for x in (of_good, ~of_good))
    return np.log((up / max(1, good.sum())) / (down / max(1, (~good).sum())))


def fit(found: np.ndarray, begins: np.ndarray, labels: np.ndarray, ratio: np.ndarray, cost: float = COST, passes: int = PASSES, seed: int = 1, close: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights by bucket and the bias: hinge loss, L2 penalty, dual coordinate descent over shuffled rows.

    ratio scales the indicators; rows are scaled to length 1 and the bias is one more feature. The rarer class has the
    same total cost as the other. Ends after `passes`, or once no dual variable moves by `close`. With one class alone
    the weights are zero and the bias its sign.
    """
    y = np.where(labels > 0, 1.0, -1.0)
    if not len(y) or abs(y.sum()) == len(y):
        return np.zeros(len(ratio)), float(y[0]) if len(y) else 0.0
    norm = np.sqrt(np.maximum(np.add.reduceat(np.append(ratio[found] ** 2, 0), begins[:-1]) * (np.diff(begins) > 0), 1e-12))
    limit = np.where(y > 0, cost * len(y) / (2 * (y > 0).sum()), cost * len(y) / (2 * (y < 0).sum()))
    w, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(seed)
    parts = [(found[a:b], ratio[found[a:b]] / n) for a, b, n in zip(begins[:-1], begins[1:], norm, strict=True)]
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(y)):
            at, x = parts[i]
            slope = y[i] * (w[at] @ x + bias) - 1.0
            new = min(max(alpha[i] - slope / 2.0, 0.0), limit[i])  # a row's squared length is 1, the bias adds 1
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * x
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < close:
            break
    return w * ratio, bias


def margins(found: np.ndarray, begins: np.ndarray, w: np.ndarray, ratio_norm: np.ndarray, bias: float) -> np.ndarray:
    """w . x + bias for rows scaled to length 1. ratio_norm: squared log-count ratio by bucket."""
    filled = np.diff(begins) > 0
    total = np.add.reduceat(np.append(w[found], 0.0), begins[:-1]) * filled if len(filled) else np.zeros(0)
    size = np.add.reduceat(np.append(ratio_norm[found], 0.0), begins[:-1]) * filled if len(filled) else np.zeros(0)
    return total / np.sqrt(np.maximum(size, 1e-12)) + bias


def calibrated(m: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve from margins to the share of label 1, by Newton's method."""
    a, b = 1.0, 0.0
    x = np.stack([m, np.ones(len(m))], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        grad = x.T @ (p - labels) + 1e-3 * np.array([a, b])
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> dict:
    """The model from (doc_id, text) and (doc_id, label 0/1), fitted in one executor task on at most `rows` rows.

    The rows are those with the smallest hash of the id, a sample that doesn't depend on order or partitions; their
    ids, at most `rows`, are broadcast to pick the texts. Null labels, ids and texts don't count; of rows with one id,
    the one with the least text does. What comes back is a weight and a squared ratio for each used bucket, BUCKETS at most.
    """
    chosen = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    picked = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    picked = picked.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for whole in batches:
            for batch in slices(whole, "text"):
                found, begins = features(batch.column(1).to_pylist(), tokens)
                own = [found[a:b] for a, b in zip(begins[:-1], begins[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(own, pa.list_(pa.int32()))], names=["doc_id", "label", "found"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        found = table.column("found").combine_chunks()
        sizes = np.diff(found.offsets.to_numpy())
        flat = found.values.to_numpy()
        y = table.column("label").to_numpy().astype(np.float64)
        test = np.arange(len(y)) % CALIBRATION == 0
        begins = np.concatenate(([0], np.cumsum(sizes)))
        part = lambda keep: (flat[np.repeat(keep, sizes)], np.concatenate(([0], np.cumsum(sizes[keep]))))
        f, b = part(~test)
        yt = y[~test]
        ratio = log_ratios(f, b, yt)
        w, bias = fit(f, b, yt, ratio)
        square = ratio**2
        slope, offset = calibrated(margins(*part(test), w, square, bias), y[test]) if test.any() else (1.0, 0.0)
        if not w.any():
            slope, offset, bias = 0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), 0.0
        plain = np.median(square)
        used = np.flatnonzero((w != 0) | (square != plain))
        yield pa.RecordBatch.from_pydict({"bucket": np.append(used, [-1, -2, -3, -4]).astype(np.int64), "weight": np.append(w[used], [bias, slope, offset, plain]), "square": np.append(square[used], np.zeros(4))})

    rows_of = picked.mapInArrow(made, "doc_id long, label int, found array<int>").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    model = rows_of.mapInArrow(fitted, "bucket long, weight double, square double").toPandas()
    out = {"w": np.zeros(BUCKETS), "square": np.zeros(BUCKETS), "bias": 0.0, "slope": 0.0, "offset": 0.0}
    if len(model):
        head = model.set_index("bucket")["weight"]
        out |= {"bias": head[-1], "slope": head[-2], "offset": head[-3]}
        out["square"][:] = head[-4]
        own = model[model["bucket"] >= 0]
        out["w"][own["bucket"].to_numpy()] = own["weight"]
        out["square"][own["bucket"].to_numpy()] = own["square"]
    return out


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """Adds quality_score (0 to 1: how likely label 1 is) to every row; a null text counts as empty. The model, two
    numbers a bucket (4 MB), is broadcast. A column of that name in `docs` is replaced."""
    kept = [c for c in docs.columns if c != "quality_score"]
    schema = extended(docs.select(*kept), "quality_score double")
    at = kept.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tokens = shared.value, Tokens()
        for whole in batches:
            for batch in slices(whole, text_col):
                found, begins = features([t or "" for t in batch.column(at).to_pylist()], tokens)
                m = margins(found, begins, own["w"], own["square"], own["bias"])
                p = 1 / (1 + np.exp(-np.clip(own["slope"] * m + own["offset"], -30, 30)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*kept, "quality_score"])

    return docs.select(*kept).mapInArrow(tidy(run), schema)


HELD_OUT_OF = 5


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document whether it is held out, its score and the prediction.

    Every row gives one, repeated ids too. A null text counts as empty and has a score; a document without id is neither
    learned from nor held out. Without any label all scores are a half. An empty table gives no rows. Only the named
    columns are read, so others can't clash.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").cast("int").alias("label"))
    model = train(docs, labels.where(fold("doc_id", HELD_OUT_OF) != 0))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(fold("doc_id", HELD_OUT_OF) == 0, F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
