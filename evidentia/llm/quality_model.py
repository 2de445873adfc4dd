r"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

Each text gives STATS statistics. Standardised, they pass through cosines of random directions, which
approximates a Gaussian kernel. Every partition of the labelled rows sums its part of the normal
equations by fold; the sums are added up in a small number of groups, and only sums reach the driver.
The ridge is solved once on all folds for scoring and once without each fold for calibration: labels
are counted by quantised out-of-fold value, and pooling adjacent violators over these counts gives
the monotone map from value to score.

Defined cases: null text counts as empty and is scored; labels without a quality are left out; a
repeated label counts each time, and repeated documents are scored each; very long texts are read whole; texts of equal
statistics score alike; extra columns are not read by the fit and kept by accepted; without usable labels of both kinds every score is the share of
label 1, or 0.5 without any label; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .common import fold, materialise

FEATURES = 192
WIDTH = 3.0
RIDGE = 3e-4
BINS = 2048
FOLDS = 4
HELD_OUT = 2
ACCEPT = 0.7
SUMMING_GROUPS = 8

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_CLASSES = np.zeros((256, 8), dtype=np.int64)
for _i in range(256):
    _c = chr(_i)
    _k = 7 if _i >= 128 else 0 if _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else 3 if _c in ".,;:?'\"()-" else 4 if _c == "!" else 5 if _i in (32, 9, 10, 11, 12, 13) else 6
    _CLASSES[_i, _k] = 1
STATS = 21


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text; none depends on which language or source it is from."""
    data = (text or "").encode()
    n = len(data)
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    share = (counts @ _CLASSES) / max(n, 1)
    words = data.split()
    m = len(words)
    distinct = len(set(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], words[2:])))
    p = counts[counts > 0] / max(n, 1)
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=m) if m else np.zeros(1)
    symbols = int(counts[[35, 42, 36, 37, 38, 124, 60, 62]].sum())
    return [
        np.log1p(m),
        *np.sqrt(share),
        np.sqrt(symbols / max(n, 1)),
        np.sqrt(symbols / max(m, 1)),
        float(lengths.mean()),
        float(lengths.std()),
        distinct / max(m, 1),
        distinct / np.sqrt(max(m, 1)),
        1 - pairs / max(m - 2, 1) if m > 2 else 0.0,
        1 - len(set(lines)) / max(len(lines), 1) if lines else 0.0,
        np.log1p(m / max(len(lines), 1)),
        float(-(p * np.log2(p)).sum()),
        sum(x[:1].isupper() and not x.isupper() for x in words) / max(m, 1),
        float((lengths <= 3).mean()) if m else 0.0,
    ]


def _describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"doc_id": frame["doc_id"], "fold": frame["fold"], "stats": [statistics(t) for t in frame["text"]]})


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, fold, stats of docs(doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", fold(docs["doc_id"], FOLDS).alias("fold"), "text").mapInPandas(_describe, f"doc_id {kind}, fold int, stats array<double>")


def _summed(df: DataFrame, per_partition) -> dict[int, np.ndarray]:
    """Sums by key: each partition's, then those of a few groups; only the groups' sums reach the driver."""
    schema = "key int, data binary"
    columns = ["key", "data"]

    def own(frames):
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            for key, value in per_partition(frame):
                sums[key] = sums[key] + value if key in sums else value
        yield pd.DataFrame([(k, v.tobytes()) for k, v in sums.items()], columns=columns)

    def add(frames):
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            for key, data in zip(frame["key"], frame["data"], strict=True):
                value = np.frombuffer(data)
                sums[key] = sums[key] + value if key in sums else value
        yield pd.DataFrame([(k, v.tobytes()) for k, v in sums.items()], columns=columns)

    rows = df.mapInPandas(own, schema).repartition(SUMMING_GROUPS).mapInPandas(add, schema).collect()
    total: dict[int, np.ndarray] = {}
    for r in rows:
        value = np.frombuffer(r["data"])
        total[r["key"]] = total[r["key"]] + value if r["key"] in total else value
    return total


class Kernel:
    """Standardisation and random directions."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.directions = rng.standard_normal((len(mean), FEATURES)) / (WIDTH * np.sqrt(len(mean)) / np.sqrt(6))
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        waves = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / FEATURES)
        return np.hstack([waves, z / 6, np.ones((len(z), 1))])


def solve(gram: np.ndarray, right: np.ndarray, n: float) -> np.ndarray:
    penalty = np.full(len(gram), RIDGE * max(n, 1.0))
    penalty[-1] = 1e-9
    return np.linalg.solve(gram + np.diag(penalty), right)


def isotonic(x: np.ndarray, ones: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators over bins: positions and non-decreasing shares of ones."""
    blocks: list[list[float]] = []
    for at, one, count in zip(x, ones, n, strict=True):
        blocks.append([at * count, one, count])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


class Model:
    def __init__(self, constant: float, kernel: Kernel | None = None, weights=None, knots=None):
        self.constant, self.kernel, self.weights, self.knots = constant, kernel, weights, knots

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        if self.kernel is None:
            return np.full(len(stats), self.constant)
        value = self.kernel(stats) @ self.weights
        # the calibrated share, leaning by a hair on the value itself so that steps keep their order
        return np.clip(0.999 * np.interp(value, *self.knots) + 0.001 * np.clip(value, 0, 1), 0, 1)


def fit(described: DataFrame, labels: DataFrame) -> Model:
    """Fit on labels(doc_id, quality) whose fold is not HELD_OUT."""
    rows = described.filter(F.col("fold") != HELD_OUT).join(labels.filter("quality IS NOT NULL").select("doc_id", "quality"), "doc_id")
    rows = materialise(rows.select("fold", F.col("quality").cast("double").alias("y"), "stats"), "labelled")

    def moments(frame: pd.DataFrame):
        if len(frame):
            x, y = np.array(frame["stats"].tolist()), frame["y"].to_numpy()
            yield 0, np.concatenate([[len(x), y.sum()], x.sum(0), (x**2).sum(0)])

    total = _summed(rows, moments).get(0)
    if total is None:
        return Model(0.5)
    n, ones = total[:2]
    if ones in (0, n):
        return Model(float(ones / n))
    mean = total[2 : 2 + STATS] / n
    scale = np.sqrt(np.maximum(total[2 + STATS :] / n - mean**2, 1e-6))
    kernel = Kernel(mean, scale)
    d = FEATURES + STATS + 1

    def normal(frame: pd.DataFrame):
        for k, part in frame.groupby("fold"):
            f, y = kernel(np.array(part["stats"].tolist())), part["y"].to_numpy()
            yield int(k), np.concatenate([(f.T @ f).ravel(), f.T @ y, [len(y)]])

    sums = _summed(rows, normal)
    parted = lambda s: (s[: d * d].reshape(d, d), s[d * d : d * d + d], s[-1])
    whole = sum(sums.values())
    weights = solve(*parted(whole))
    without = {k: solve(*parted(whole - s)) if len(sums) > 1 else weights for k, s in sums.items()}

    def counted(frame: pd.DataFrame):
        for k, part in frame.groupby("fold"):
            value = kernel(np.array(part["stats"].tolist())) @ without[int(k)]
            at = np.clip(((value + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
            yield 0, np.concatenate([np.bincount(at, weights=part["y"], minlength=BINS), np.bincount(at, minlength=BINS).astype(float)])

    histogram = _summed(rows, counted)[0]
    got, seen = histogram[:BINS], histogram[BINS:]
    used = seen > 0
    centres = (np.arange(BINS) + 0.5) / BINS * 2 - 0.5
    return Model(0.0, kernel, weights, isotonic(centres[used], got[used], seen[used]))


def score(described: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                value = model(np.array(frame["stats"].tolist()))
                yield pd.DataFrame({"doc_id": frame["doc_id"], "held_out": frame["fold"] == HELD_OUT, "score": value, "predicted": (value >= ACCEPT).astype(np.int32)})

    kind = described.schema["doc_id"].dataType.simpleString()
    return described.mapInPandas(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    described = materialise(describe(docs), "described")
    return score(described, fit(described, labels))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier accepts, with docs' columns."""
    described = materialise(describe(docs), "described")
    model = fit(described, labels)

    @F.pandas_udf(BooleanType())
    def good(text: pd.Series) -> pd.Series:
        return pd.Series(model(np.array([statistics(t) for t in text])) >= ACCEPT if len(text) else [], dtype=bool)

    return docs.filter(good(docs["text"]))


def op4_quality_classifier(spark, sf_dir):
    from .common import table

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
