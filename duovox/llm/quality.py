"""Quality classifier: n-gram indicators scaled by naive Bayes log-count ratios, then a linear hinge-loss model by dual coordinate descent."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duovox.llm.common import batch_udf, ready, stash, text_or_empty

BITS = 17
SIZE = 1 << BITS
SHAPES = 1 << 12
REPEAT = SHAPES - 1
THRESHOLD = 0.3
#: Labelled documents that a classifier learns from at most, half of each label: a bound on what is broadcast and collected.
LEARNED = 20_000
MIX = np.uint64(0x9E3779B97F4A7C15)
_upper, _lower, _digit, _runs = re.compile(r"[^\W\d_]+"), re.compile(r"a+"), re.compile(r"\d+"), re.compile(r"([^aA0])\1+")


def shape(word: str) -> str:
    """A word's outline: letters as a, or A if all are capitals, digits as 0, runs of one sign as that sign."""
    out = _upper.sub(lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "a", word)
    return _runs.sub(r"\1", _digit.sub("0", out))


class WordCodes(dict):
    """Per word: a hash, with the number of its outline in the low bits."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        outline = xxhash.xxh3_64_intdigest(shape(word).encode("utf-8", "replace")) % REPEAT
        code = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace")) // SHAPES * SHAPES + outline
        return code


def features(text: str, codes: WordCodes) -> np.ndarray:
    """The distinct n-grams of a whole text as sorted bin numbers: words, and 1 to 3 outlines in a row. A word that repeats the one before has an outline of its own."""
    words = text.split()
    if not words:
        return np.empty(0, np.int32)
    code = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    outline = code % np.uint64(SHAPES)
    outline[1:][code[1:] == code[:-1]] = REPEAT
    grams, gram = [code >> np.uint64(12)], np.zeros(len(words) + 1, np.uint64)
    for n in range(min(3, len(words))):
        gram = gram[:-1] * MIX + outline[n:] + np.uint64(1)
        gram ^= gram >> np.uint64(29)
        grams.append(gram * MIX)
    bins = np.concatenate(grams) * MIX >> np.uint64(64 - BITS)
    return np.unique(bins).astype(np.int32)


def descend(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, ratio: np.ndarray, c: float = 1.0, epochs: int = 15, seed: int = 0) -> np.ndarray:
    """Weights (the last is the bias) of min |w|^2 / 2 + sum of c weight hinge(y w.x), by dual coordinate descent.

    x: a row's indicators times ratio, at unit length, and a constant 1.
    """
    w = np.zeros(len(ratio) + 1)
    norms = [max(1e-12, float(np.sqrt((ratio[r] ** 2).sum()))) for r in rows]
    values = [ratio[r] / n for r, n in zip(rows, norms)]
    alpha, rng = np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r, x = rows[i], values[i]
            square = float(x @ x) + 1
            new = min(max(alpha[i] - (y[i] * (w[r] @ x + w[-1]) - 1) / square, 0.0), c * weight[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * x
                w[-1] += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def margins(rows: list[np.ndarray], w: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    scaled = w[:-1] * ratio
    return np.array([scaled[r].sum() / max(1e-12, float(np.sqrt((ratio[r] ** 2).sum()))) + w[-1] for r in rows])


def logistic(m: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a m + b))) by Newton steps, with a slight pull of a to 1."""
    a, b = 1.0, 0.0
    t, weight = (y + 1) / 2, weight / weight.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -35, 35)))
        g = np.array([(weight * (p - t) * m).sum() + 1e-3 * (a - 1), (weight * (p - t)).sum()])
        h = weight * p * (1 - p)
        hess = np.array([[(h * m * m).sum() + 1e-3, (h * m).sum()], [(h * m).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess + 1e-9 * np.eye(2), g)
        step *= min(1, 4 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


class Model:
    """ratio: log-count ratio by bin; weights: of the linear model; a, b: from margin to probability."""

    def __init__(self, ratio: np.ndarray, weights: np.ndarray, a: float, b: float):
        self.ratio, self.weights, self.a, self.b = ratio.astype(np.float32), weights.astype(np.float32), a, b

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        m = margins(rows, self.weights.astype(float), self.ratio.astype(float))
        return 1 / (1 + np.exp(-np.clip(self.a * m + self.b, -35, 35)))


def with_features(df: DataFrame, *keep: str) -> DataFrame:
    """The columns keep, and bins (array of int)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = WordCodes()
        for f in frames:
            yield f[list(keep)].assign(bins=[features(t, codes) for t in f["text"]])

    ready(df.sparkSession)
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keep)
    return df.mapInPandas(run, f"{kinds}, bins array<int>")


def fit(labelled: DataFrame, sample: int = 4000, smooth: float = 1.0) -> Model:
    """Fit on rows (doc_id, text, label 0 or 1), one for each id and label.

    Log-count ratios come from all of them: each task sums its counts, and at most 2 x 2^BITS sums reach the driver. The linear model
    is fitted on a bounded sample: of each label the `sample` / 2 ids with the least hashed doc_id. Scores are calibrated
    on two halves, each by the other's model, at the labels' shares in all rows. Without rows of both labels all scores are that of
    the label that there is, or 0.5 without any.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, total, rows = WordCodes(), np.zeros((2, SIZE), np.int64), np.zeros(2, np.int64)
        for f in frames:
            for text, label in zip(f["text"], f["label"]):
                total[label, features(text, codes)] += 1
                rows[label] += 1
        for label in (0, 1):
            used = np.flatnonzero(total[label])
            yield pd.DataFrame({"label": label, "bin": np.r_[-1, used], "n": np.r_[rows[label], total[label, used]]})

    ready(labelled.sparkSession)
    sums = labelled.select("text", "label").mapInPandas(count, "label int, bin int, n long").groupBy("label", "bin").agg(F.sum("n").alias("n")).toArrow()
    counts, rows = np.zeros((2, SIZE)), np.zeros(2)
    for label, at, n in zip(*(sums[c].to_numpy() for c in ("label", "bin", "n"))):
        if at < 0:
            rows[label] = n
        else:
            counts[label, at] = n
    if not rows.all():
        b = 0.0 if not rows.any() else 35.0 if rows[1] else -35.0
        return Model(np.zeros(SIZE), np.zeros(SIZE + 1), 1.0, b)
    p = counts + smooth
    ratio = np.log(p[1] / p[1].sum()) - np.log(p[0] / p[0].sum())
    picked = None
    for label in (0, 1):
        part = labelled.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2)
        picked = part if picked is None else picked.union(part)
    data = with_features(picked.select("text", "label"), "label").toArrow()
    order = np.argsort([xxhash.xxh3_64_intdigest(np.asarray(b.values).tobytes()) for b in data["bins"]], kind="stable")
    bins = [np.asarray(data["bins"][int(i)].values) for i in order]
    y = np.where(data["label"].to_numpy()[order] == 1, 1.0, -1.0)
    share = np.array([(y < 0).sum(), (y > 0).sum()])
    even = np.where(y > 0, len(y) / 2 / share[1], len(y) / 2 / share[0])
    natural = np.where(y > 0, rows[1] / share[1], rows[0] / share[0])
    half = np.arange(len(y)) % 2
    crossed = np.zeros(len(y))
    for k in (0, 1):
        own = np.flatnonzero(half == k)
        w = descend([bins[i] for i in own], y[own], even[own], ratio)
        other = np.flatnonzero(half != k)
        crossed[other] = margins([bins[i] for i in other], w, ratio)
    a, b = logistic(crossed, y, natural)
    return Model(ratio, descend(bins, y, even, ratio), a, b)


def training_ids(labels: DataFrame, learned: int) -> DataFrame:
    """doc_id, label of the documents to learn from: those with a label 0 or 1 whose crc32(doc_id as text) mod 5 is not 0; of
    each label the `learned` / 2 ids with the least hashed doc_id."""
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out()).select("doc_id", F.col("quality").cast("int").alias("label"))
    parts = [known.where(F.col("label") == k).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(learned // 2) for k in (0, 1)]
    return parts[0].union(parts[1])


def training_rows(docs: DataFrame, labels: DataFrame, learned: int = LEARNED) -> DataFrame:
    """doc_id, text, label of at most `learned` documents, as a table in the shared folder; where rows repeat an id, the least text.

    The ids come from the narrow labels alone. Their number bounds what is broadcast, so the texts stay where they are
    read, and only the chosen ones are shuffled and written.
    """
    ids = training_ids(labels, learned)
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(ids), "doc_id")
    return stash(texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")))


def held_out(ident: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(ident).cast("string")) % 5 == 0, F.lit(False))


def with_score(docs: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """docs with the probability of label 1 of each whole text; null texts count as empty."""
    shared = ready(docs.sparkSession).sparkContext.broadcast(model)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codes, model = WordCodes(), shared.value
        for texts in parts:
            yield pd.Series(model.score([features(t, codes) for t in texts]), dtype="float64")

    return docs.withColumn(score, batch_udf(run, "double")(text_or_empty()))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs.

    Null and empty texts get a score too; long texts are read whole. Repeated rows and null ids (not held out) pass through;
    other columns are ignored; an empty table gives no rows, and without labels all scores are 0.5.
    """
    model = fit(training_rows(docs, labels))
    scored = with_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the classifier rejects; all columns stay."""
    score = "_score"
    while score in docs.columns:
        score += "_"
    return with_score(docs, fit(training_rows(docs, labels)), score).where(F.col(score) >= THRESHOLD).select(*docs.columns)
