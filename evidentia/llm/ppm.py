r"""Language-model scoring by partial matching (PPM, escape method C with symbol exclusion).

The model is a trie of byte contexts up to ORDER bytes, counted over all training documents; texts
are lower-cased (A-Z), their words joined by single spaces and closed by an end symbol. A text's
score is the log10 of the probability that the frozen model gives it, end included.

No part of the model is held whole by any task. Documents are dealt into blocks of about BLOCK_BYTES
of text. A block reports its distinct (context, byte) keys and distinct words with training counts,
already summed; these are summed by key over all blocks. Contexts that share their last two bytes
are completed together: a key's escapes lead only to suffixes of its context, and those of under two
bytes are a table of at most 65,536 counts, which is handed to all tasks. The log-probabilities then
return to the blocks that asked for them.

The base score is that of single words with additive smoothing.

Defined cases: null text counts as empty and scores its end symbol; a null id is held out (fold 0);
rows that repeat are trained and scored each; very long texts are trained and scored whole; extra columns are not
read; without training documents every byte has probability
1/256; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialise, parts, text_or_empty

FOLDS = 10
HELD_OUT = 0
ORDER = 4
BLOCK_BYTES = 8 << 20
STOP = b"\n"
#: Words have negative keys, (context, byte) keys are not negative; this word key is the end token's.
END_KEY = np.int64(-(2**63))


def _keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Byte keys of all texts, how many each text has, all words, and how many each text has."""
    bodies, words, n_words = [], [], []
    for text in texts:
        own = text.encode().lower().split()
        words += own
        n_words.append(len(own))
        bodies.append(STOP * ORDER + b" ".join(own) + STOP)
    data = np.frombuffer(b"".join(bodies), dtype=np.uint8).astype(np.int64)
    sizes = np.array([len(b) for b in bodies], dtype=np.int64)
    key = data[ORDER:].copy()
    for i in range(1, ORDER + 1):
        key |= data[ORDER - i : len(data) - i] << (8 * i)
    ends = np.cumsum(sizes)
    use = np.ones(len(data), dtype=bool)
    for i in range(ORDER):
        use[ends - sizes + i] = False
    return key[use[ORDER:]], sizes - ORDER, words, np.array(n_words, dtype=np.int64)


def _word_keys(distinct: list[bytes]) -> np.ndarray:
    hashed = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct), dtype=np.uint64, count=len(distinct))
    return (hashed | np.uint64(1 << 63)).view(np.int64)


def _encode(values) -> tuple[np.ndarray, list]:
    coded = (values if isinstance(values, pa.Array) else pa.array(values)).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def _count_block(key: tuple, block: pa.Table) -> pa.Table:
    keys, sizes, words, n_words = _keys(block["text"].to_pylist())
    train = ~block["held_out"].to_numpy(zero_copy_only=False).astype(bool)
    at, distinct = _encode(keys)
    gram_counts = np.bincount(at, weights=np.repeat(train, sizes), minlength=len(distinct))
    grams = distinct.to_numpy()
    at, distinct = _encode(pa.array(words, pa.binary()))
    word_counts = np.bincount(at, weights=np.repeat(train, n_words), minlength=len(distinct))
    word_keys = _word_keys(distinct.to_pylist())
    all_keys = np.concatenate([grams, word_keys, [END_KEY]])
    counts = np.concatenate([gram_counts, word_counts, [train.sum()]]).astype(np.int64)
    order = np.argsort(all_keys)
    return pa.table({"block": np.full(len(order), key[0].as_py(), dtype=np.int64), "key": all_keys[order], "n": counts[order]})


def _sums(index: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(index, weights=weights, minlength=size)


def context_probabilities(keys: np.ndarray, counts: np.ndarray, low: np.ndarray) -> np.ndarray:
    """log10 probability of each key's byte after its context; all keys share the last two context bytes.

    keys holds every key with these bytes that occurs anywhere, counts its training count; low is the
    256 x 256 table of training counts of (byte, next byte).
    """
    s = keys & 255
    last = int(keys[0] >> 8 & 255)
    c3 = (keys >> 24 & 255).astype(np.int64)
    c4 = (keys >> 24 & 65535).astype(np.int64)
    seen = counts > 0
    # order 4: (context, byte) counts are the keys' own
    _, i4 = np.unique(c4, return_inverse=True)
    n4 = int(i4.max()) + 1
    t4, d4 = _sums(i4, counts, n4), _sums(i4, seen, n4)
    # order 3 and 2: summed over what precedes
    pair3, k3 = np.unique(c3 * 256 + s, return_inverse=True)
    f3 = _sums(k3, counts, len(pair3))
    ctx3, i3 = np.unique(c3, return_inverse=True)
    of_pair = np.searchsorted(ctx3, pair3 // 256)
    t3, d3 = _sums(of_pair, f3, len(ctx3)), _sums(of_pair, f3 > 0, len(ctx3))
    f2 = _sums(s, counts, 256)
    t2, d2 = f2.sum(), float((f2 > 0).sum())
    f1 = low[last]
    t1, d1 = f1.sum(), float((f1 > 0).sum())
    f0 = low.sum(0)
    t0, d0 = f0.sum(), float((f0 > 0).sum())
    # what an order excludes below it: the symbols seen in it, which all occur in its suffix
    x4 = _sums(i4, np.where(seen, f3[k3], 0.0), n4)
    x3 = _sums(of_pair, np.where(f3 > 0, f2[pair3 % 256], 0.0), len(ctx3))
    x2, x1 = f1[f2 > 0].sum(), f0[f1 > 0].sum()
    one = np.ones(len(keys))
    levels = [
        (counts, t4[i4], d4[i4]),
        (f3[k3], t3[i3] - x4[i4], d3[i3] - d4[i4]),
        (f2[s], one * t2 - x3[i3], one * d2 - d3[i3]),
        (f1[s], one * (t1 - x2), one * (d1 - d2)),
        (f0[s], one * (t0 - x1), one * (d0 - d1)),
    ]
    out, done = np.zeros(len(keys)), np.zeros(len(keys), dtype=bool)
    for f, t, d in levels:
        live = ~done & (d > 0)  # with no symbol left the escape is certain
        total = np.where(live, t + d, 1.0)
        hit = live & (f > 0)
        out[hit] += np.log10(f[hit] / total[hit])
        miss = live & ~hit
        out[miss] += np.log10(d[miss] / total[miss])
        done |= hit
    out[~done] -= np.log10(max(1.0, 256 - d0))
    return out


def _completed(low: np.ndarray):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        keys = frame["key"].to_numpy()
        return pd.DataFrame({"key": keys, "value": context_probabilities(keys, frame["n"].to_numpy().astype(float), low)})

    return run


def _score_block(word_total: float, word_distinct: float):
    smooth = word_total + 0.1 * (word_distinct + 1)

    def run(block: pa.Table, values: pa.Table) -> pa.Table:
        texts = block["text"].to_pylist()
        if not texts:
            texts = []
        keys, sizes, words, n_words = _keys(texts) if texts else (np.zeros(0, np.int64), np.zeros(0, np.int64), [], np.zeros(0, np.int64))
        have = values["key"].to_numpy()
        order = np.argsort(have)
        have, value = have[order], values["value"].to_numpy()[order]
        look = lambda k: value[np.searchsorted(have, k)]
        at, distinct = _encode(keys)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        score = np.add.reduceat(look(distinct.to_numpy())[at], starts) if len(sizes) else np.zeros(0)
        at, distinct = _encode(pa.array(words, pa.binary()))
        count = look(_word_keys(distinct.to_pylist()))[at] if words else np.zeros(0)
        doc = np.repeat(np.arange(len(n_words)), n_words)
        end = float(look(np.array([END_KEY]))[0]) if len(have) else 0.0
        base = np.bincount(doc, weights=np.log10((count + 0.1) / smooth), minlength=len(n_words)) + np.log10((end + 0.1) / smooth)
        known = np.bincount(doc, weights=count > 0, minlength=len(n_words)) + (end > 0)
        return pa.table({"doc_id": block["doc_id"], "held_out": block["held_out"], "n_tokens": n_words + 1, "n_known": known.astype(np.int64), "base_score": base, "score": score})

    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for docs(doc_id, text)."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(2 * parts(spark), size // BLOCK_BYTES + 1)
    text = text_or_empty(docs)
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", text), F.lit(blocks)).alias("block"), "doc_id", (fold(docs["doc_id"], FOLDS) == HELD_OUT).alias("held_out"), text.alias("text"))
    asked = materialise(dealt.groupBy("block").applyInArrow(_count_block, "block long, key long, n long"), "asked")
    totals = materialise(asked.groupBy("key").agg(F.sum("n").alias("n")), "totals")
    grams, words = totals.filter("key >= 0"), totals.filter("key < 0")
    n, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    low = np.zeros((256, 256))
    for r in grams.groupBy((F.col("key").bitwiseAND(65535)).alias("pair")).agg(F.sum("n").alias("n")).collect():
        low[r["pair"] >> 8, r["pair"] & 255] = r["n"]
    near = F.shiftright("key", 8).bitwiseAND(65535)
    known = grams.groupBy(near.alias("near")).applyInPandas(_completed(low), "key long, value double")
    values = materialise(known.unionByName(words.select("key", F.col("n").cast("double").alias("value"))), "values")
    answers = asked.select("block", "key").join(values, "key").select("block", "key", "value")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _score_block(float(n), float(distinct)), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")


def op9_lm_scoring(spark, sf_dir):
    from .common import table

    return score(table(spark, sf_dir, "documents"))
