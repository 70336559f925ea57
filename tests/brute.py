"""BM25 in plain Python, to hold the engine against."""

import math
import re
from collections import Counter

import numpy as np

f32 = np.float32


def tokens(text):
    return re.findall(r"\w+", (text or "").lower())


def idf(method, n, df):
    ratio = {"robertson": (n - df + 0.5) / (df + 0.5), "lucene": 1 + (n - df + 0.5) / (df + 0.5), "atire": n / df, "bm25l": (n + 1) / (df + 0.5), "bm25plus": (n + 1) / df}[method]
    return float(f32(math.log(ratio)))


def weight(method, tf, dl, mean, k1=1.5, b=0.75, delta=0.5):
    k1, b, delta = float(f32(k1)), float(f32(b)), float(f32(delta))
    norm = 1 - b + b * dl / mean
    out = {
        "robertson": lambda: tf / (k1 * norm + tf), "lucene": lambda: tf / (k1 * norm + tf), "atire": lambda: tf * (k1 + 1) / (tf + k1 * norm),
        "bm25l": lambda: (k1 + 1) * (tf + delta) / (k1 + tf + delta), "bm25plus": lambda: (k1 + 1) * tf / (k1 * norm + tf) + delta,
    }[method]()
    return float(f32(out))


def postings(docs, method="lucene", **params):
    """{(term, doc): score} of {doc: text}."""
    counts = {d: Counter(tokens(t)) for d, t in docs.items()}
    lengths = {d: sum(c.values()) for d, c in counts.items()}
    mean = float(f32(float(f32(sum(lengths.values()))) / float(f32(len(docs)))))
    df = Counter(t for c in counts.values() for t in c)
    return {(t, d): float(f32(idf(method, len(docs), df[t]) * weight(method, n, lengths[d], mean, **params))) for d, c in counts.items() for t, n in c.items()}


def search(held, query, k, docs):
    scores = {d: sum(held.get((t, d), 0.0) for t in tokens(query)) for d in docs}
    best = sorted(((s, d) for d, s in scores.items() if s > 1e-12), key=lambda x: (-round(x[0], 9), x[1]))[:k]
    return [(d, s) for s, d in best]
