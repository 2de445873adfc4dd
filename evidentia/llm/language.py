r"""Language identification with a convolutional network over bytes.

Bytes are embedded, filters of several widths slide over windows of WINDOW bytes, each filter keeps
its maximum over the window, and a softmax over languages follows. Training is in numpy (Adam): STEPS
batches of BATCH windows, drawn with equal shares of the languages from a bounded sample. That sample is about
SAMPLE_PER_LANGUAGE labelled documents a language, chosen by hash within the language, with all their windows if these are
no more than WINDOWS_PER_LANGUAGE, else about so many, chosen by hash; so the driver holds
about 8 MB a language, however long the texts are.
All windows of a whole text are scored and their log-probabilities averaged by length.

For scoring, embedding and filters are folded into tables by byte and byte pair: a filter's response
is a sum of table rows, which is the same number as the convolution.

Defined cases: text that is null or has no letter gives und with score 0; rows without a language
teach nothing; without any labelled row every text is und; every language with a labelled text that
has a letter is learned; repeated rows are sampled and predicted each; of equal probabilities the first
language in code point order is predicted; very long texts are read whole; extra columns are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

FOLDS = 4
HELD_OUT = 2
SAMPLE_PER_LANGUAGE = 600
WINDOWS_PER_LANGUAGE = 1 << 16
WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDED = 8
STEPS = 500
BATCH = 64
BLOCK = 64

_LETTER = re.compile(r"[^\W\d_]")


def windows(data: bytes) -> np.ndarray:
    """All windows of the text, one a row; the last is filled with zero bytes."""
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), dtype=np.uint8).reshape(n, WINDOW)


class Network:
    def __init__(self, languages: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages = languages
        k = len(languages)
        f = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"embed": f(256, EMBEDDED, scale=1.0)}
        for w in WIDTHS:
            self.p[f"conv{w}"] = f(w * EMBEDDED, FILTERS, scale=1 / np.sqrt(w * EMBEDDED))
            self.p[f"bias{w}"] = np.zeros(FILTERS, np.float32)
        self.p["out"] = f(len(WIDTHS) * FILTERS, k, scale=0.1)
        self.p["out_bias"] = np.zeros(k, np.float32)

    def _forward(self, batch: np.ndarray):
        """Log-probabilities and what the backward pass needs."""
        e = self.p["embed"][batch]
        kept, pooled = [], []
        for w in WIDTHS:
            n = batch.shape[1] - w + 1
            cols = np.concatenate([e[:, i : i + n] for i in range(w)], axis=2)
            resp = cols.reshape(-1, w * EMBEDDED) @ self.p[f"conv{w}"]
            resp = resp.reshape(len(batch), n, FILTERS)
            at = resp.argmax(1)
            top = np.take_along_axis(resp, at[:, None], 1)[:, 0] + self.p[f"bias{w}"]
            kept.append((cols, at, top > 0))
            pooled.append(np.maximum(top, 0))
        hidden = np.concatenate(pooled, axis=1)
        z = hidden @ self.p["out"] + self.p["out_bias"]
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True)), hidden, kept

    def _gradients(self, batch: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        logp, hidden, kept = self._forward(batch)
        dz = np.exp(logp)
        dz[np.arange(len(y)), y] -= 1
        dz /= len(y)
        g = {"out": hidden.T @ dz, "out_bias": dz.sum(0), "embed": np.zeros_like(self.p["embed"])}
        dh = dz @ self.p["out"].T
        for j, w in enumerate(WIDTHS):
            cols, at, on = kept[j]
            d = dh[:, j * FILTERS : (j + 1) * FILTERS] * on
            g[f"bias{w}"] = d.sum(0)
            seen = np.take_along_axis(cols, at[:, :, None], 1)
            g[f"conv{w}"] = np.einsum("bfc,bf->cf", seen, d)
            back = (d[:, :, None] * self.p[f"conv{w}"].T[None]).reshape(*d.shape, w, EMBEDDED)
            spots = np.take_along_axis(batch[:, None, :], at[:, :, None] + np.arange(w), 2)
            np.add.at(g["embed"], spots.ravel(), back.reshape(-1, EMBEDDED))
        return g

    def train(self, data: np.ndarray, y: np.ndarray, seed: int = 13) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        by_class = [np.flatnonzero(y == k) for k in range(len(self.languages))]
        by_class = [x for x in by_class if len(x)]
        for step in range(1, STEPS + 1):
            pick = np.concatenate([rng.choice(x, max(1, BATCH // len(by_class))) for x in by_class])
            rate = 0.01 * (1 - step / (STEPS + 1))
            for k, g in self._gradients(data[pick], y[pick]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        self._fold()

    def _fold(self) -> None:
        """Tables: by pair for widths 2 and 3 and the first half of 4, by pair for its second half, by byte for the third."""
        one = {(w, i): self.p["embed"] @ self.p[f"conv{w}"][i * EMBEDDED : (i + 1) * EMBEDDED] for w in WIDTHS for i in range(w)}
        pair = lambda w, i: (one[w, i][:, None] + one[w, i + 1][None]).reshape(65536, FILTERS)
        self.first = np.concatenate([pair(w, 0) for w in WIDTHS], axis=1)
        self.second, self.third = pair(4, 2), one[3, 2]

    def log_probabilities(self, batch: np.ndarray) -> np.ndarray:
        at = batch.T.astype(np.int32)  # positions first: the maximum runs over whole rows
        pairs, n, f = at[:-1] << 8 | at[1:], WINDOW - 3, FILTERS
        resp = self.first.take(pairs, axis=0)
        resp[: n + 1, :, f : 2 * f] += self.third.take(at[2:], axis=0)
        resp[:n, :, 2 * f :] += self.second.take(pairs[2:], axis=0)
        top = np.concatenate([resp[:, :, :f].max(0), resp[: n + 1, :, f : 2 * f].max(0), resp[:n, :, 2 * f :].max(0)], axis=1)
        bias = np.concatenate([self.p[f"bias{w}"] for w in WIDTHS])
        z = np.maximum(top + bias, 0) @ self.p["out"] + self.p["out_bias"]
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def _sample_windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Windows of sampled texts; of a language that has too many, those whose hash is below its share."""
    for frame in frames:
        rows = []
        for lang, text, share in zip(frame["lang"], frame["text"], frame["share"], strict=True):
            if text and _LETTER.search(text):
                rows += [(lang, row.tobytes()) for i, row in enumerate(windows(text.encode())) if share >= 1 or xxhash.xxh64_intdigest(row.tobytes(), i & 0xFFFFFFFF) < share * 2**64]
        yield pd.DataFrame(rows, columns=["lang", "data"])


def fit(docs: DataFrame) -> Network | None:
    """Learn from docs(doc_id, text, lang) whose fold is not HELD_OUT."""
    rows = docs.filter((fold(docs["doc_id"], FOLDS) != HELD_OUT) & docs["lang"].isNotNull() & docs["text"].isNotNull())
    sizes = rows.groupBy("lang").count().collect()  # one row for each class of the model
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, SAMPLE_PER_LANGUAGE / r["count"]))])
    key = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20)) / float(1 << 20)
    sampled = rows.filter(key < F.element_at(share, F.col("lang"))).select("lang", "text")
    counts = sampled.groupBy("lang").agg(F.sum(F.greatest(F.lit(1), F.ceil(F.octet_length("text") / WINDOW))).alias("n")).collect()
    if not counts:
        return None
    of_windows = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, WINDOWS_PER_LANGUAGE / r["n"]))])
    sampled = sampled.withColumn("share", F.element_at(of_windows, F.col("lang")))
    got = sampled.mapInPandas(_sample_windows, "lang string, data binary").toPandas()
    if got.empty:
        return None
    got = got.sort_values(["lang", "data"], kind="stable")
    languages = sorted(set(got["lang"]))
    net = Network(languages)
    data = np.frombuffer(b"".join(got["data"]), dtype=np.uint8).reshape(-1, WINDOW)
    net.train(data, np.array([languages.index(x) for x in got["lang"]]))
    return net


def _predict(net: Network | None):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [t if net is not None and t and _LETTER.search(t) else None for t in frame["text"]]
            rows = [windows(t.encode()) for t in texts if t]
            name, top = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
            if rows:
                weights = np.concatenate([(r != 0).sum(1) for r in rows]).astype(np.float64) + 1e-3
                flat = np.concatenate(rows)
                logp = np.concatenate([net.log_probabilities(flat[i : i + BLOCK]) for i in range(0, len(flat), BLOCK)])
                starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]])
                mean = np.add.reduceat(logp * weights[:, None], starts) / np.add.reduceat(weights, starts)[:, None]
                p = np.exp(mean - mean.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                where = [i for i, t in enumerate(texts) if t]
                name[where] = np.array(net.languages, dtype=object)[best]
                top[where] = p[np.arange(len(best)), best]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "held_out": frame["held_out"], "lang_pred": name, "score": top})

    return run


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs(doc_id, text, lang)."""
    net = fit(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (fold(docs["doc_id"], FOLDS) == HELD_OUT).alias("held_out"), "text")
    return rows.mapInPandas(_predict(net), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op5_language_id(spark, sf_dir):
    from .common import table

    return identify(table(spark, sf_dir, "documents"))
