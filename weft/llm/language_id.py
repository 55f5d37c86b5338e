"""Language identification by a byte convolutional network trained in numpy.

A text is cut into windows of ``WINDOW`` bytes that cover it whole. Bytes are
embedded, filters of several widths slide over them, each filter keeps its maximum
in the window (max pooling), and a softmax layer names the language. A text's
distribution is the mean over its windows, weighted by their bytes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 256
WIDTHS = (2, 3, 4)
_PAD = max(WIDTHS) - 1
_LETTER = re.compile(r"[^\W\d_]")


def windows(texts: list[bytes]):
    """(window bytes as uint8 [n, WINDOW + pad], owner, bytes held) covering every text; padding is byte 0."""
    sizes = np.asarray([len(t) for t in texts], np.int64)
    n = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(texts)), n)
    out = np.zeros((len(owner), WINDOW + _PAD), np.uint8)
    held = np.full(len(owner), WINDOW, np.int64)
    at = 0
    for i, t in enumerate(texts):
        if not n[i]:
            continue
        own = np.frombuffer(t, np.uint8)
        flat = np.zeros(n[i] * WINDOW + _PAD, np.uint8)
        flat[: len(own)] = own
        out[at : at + n[i]] = np.lib.stride_tricks.sliding_window_view(flat, WINDOW + _PAD)[::WINDOW]
        held[at + n[i] - 1] = len(own) - (n[i] - 1) * WINDOW
        at += n[i]
    return out, owner, held


@dataclass
class ByteCNN:
    """Embedding, filter bank (all widths laid into the widest, unused taps zero) and softmax layer."""

    classes: list[str]
    embed: np.ndarray  # 256 x E
    filters: np.ndarray  # (max width * E) x F
    bias: np.ndarray  # F
    out: np.ndarray  # F x C
    out_bias: np.ndarray  # C

    def pooled(self, x: np.ndarray):
        """Max over positions of each filter, and the position it comes from."""
        e = self.embed[x]
        n, length, d = e.shape
        cols = np.lib.stride_tricks.sliding_window_view(e, max(WIDTHS), axis=1)  # n, pos, d, tap
        cols = np.ascontiguousarray(cols.transpose(0, 1, 3, 2)).reshape(-1, max(WIDTHS) * d)
        z = (cols @ self.filters).reshape(n, length - max(WIDTHS) + 1, -1)
        return z, cols

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.zeros((len(x), 0), np.float32)
        p = np.empty((len(x), len(self.classes)), np.float32)
        for i in range(0, len(x), 256):
            z, _ = self.pooled(x[i : i + 256])
            h = np.maximum(z.max(1) + self.bias, 0)
            s = h @ self.out + self.out_bias
            s = np.exp(s - s.max(1, keepdims=True))
            p[i : i + 256] = s / s.sum(1, keepdims=True)
        return p


def _taps(d: int, per_width: int) -> np.ndarray:
    """Mask of the filter bank: a filter of width w uses the first w taps."""
    mask = np.zeros((max(WIDTHS), d, per_width * len(WIDTHS)), np.float32)
    for i, w in enumerate(WIDTHS):
        mask[:w, :, i * per_width : (i + 1) * per_width] = 1
    return mask.reshape(max(WIDTHS) * d, -1)


def fit(texts: list[bytes], labels: list[str], per_width: int = 8, d: int = 6, epochs: int = 6, per_text: int = 3, seed: int = 7, rate: float = 0.01, batch: int = 64) -> ByteCNN:
    """Train by Adam on at most ``per_text`` windows of each text. Deterministic for the same input and order."""
    classes = sorted(set(labels))
    rng = np.random.Generator(np.random.PCG64(seed))
    f = per_width * len(WIDTHS)
    net = ByteCNN(
        classes,
        rng.normal(0, 0.5, (256, d)).astype(np.float32),
        (rng.normal(0, 0.3, (max(WIDTHS) * d, f)) * _taps(d, per_width)).astype(np.float32),
        np.zeros(f, np.float32),
        rng.normal(0, 0.3, (f, len(classes))).astype(np.float32),
        np.zeros(len(classes), np.float32),
    )
    x, owner, held = windows(texts)
    if not len(x) or len(classes) < 2:
        return net
    order = rng.permutation(len(x))
    seen = np.zeros(len(texts), np.int64)
    pick = []
    for i in order:
        if held[i] >= min(32, len(texts[owner[i]])) and seen[owner[i]] < per_text:
            seen[owner[i]] += 1
            pick.append(i)
    x, y = x[pick], np.asarray([classes.index(labels[o]) for o in owner[pick]])
    weight = (len(y) / (len(classes) * np.maximum(np.bincount(y, minlength=len(classes)), 1)))[y].astype(np.float32)
    weight = np.sqrt(weight)
    mask = _taps(d, per_width)
    names = ("embed", "filters", "bias", "out", "out_bias")
    m = {k: np.zeros_like(getattr(net, k)) for k in names}
    v = {k: np.zeros_like(getattr(net, k)) for k in names}
    t = 0
    for epoch in range(epochs):
        perm = rng.permutation(len(x))
        for i in range(0, len(perm), batch):
            at = perm[i : i + batch]
            xb, yb, wb = x[at], y[at], weight[at]
            z, cols = net.pooled(xb)
            n, length, _ = z.shape
            where = z.argmax(1)
            top = np.take_along_axis(z, where[:, None], 1)[:, 0] + net.bias
            h = np.maximum(top, 0)
            s = h @ net.out + net.out_bias
            p = np.exp(s - s.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = p
            g[np.arange(n), yb] -= 1
            g *= (wb / n)[:, None]
            gh = (g @ net.out.T) * (top > 0)
            rows = (np.arange(n)[:, None] * length + where).ravel()
            taken = cols[rows].reshape(n, f, -1)
            g_filters = np.einsum("nfk,nf->kf", taken, gh) * mask
            back = (gh[:, :, None] * net.filters.T[None]).reshape(n, f, max(WIDTHS), d)
            g_embed = np.zeros_like(net.embed)
            at_bytes = where[:, :, None] + np.arange(max(WIDTHS))
            np.add.at(g_embed, xb[np.arange(n)[:, None, None], at_bytes].ravel(), back.reshape(-1, d))
            grads = {"embed": g_embed, "filters": g_filters, "bias": gh.sum(0), "out": h.T @ g, "out_bias": g.sum(0)}
            t += 1
            step = rate * (1 - epoch / epochs * 0.8)
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
                getattr(net, k)[...] -= step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return net


def train(docs: DataFrame, out_of_fold: Column, max_rows: int = 3_000, max_bytes: int = 64_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> ByteCNN:
    """Fit on a bounded sample of labelled rows outside the fold, less those without a letter or over ``max_bytes``.

    Every language has the same share of ``max_rows`` (8 rows at least); one with fewer rows has them all. A language's
    sample are the rows whose hash of id and text lies below its rate, of equal rows one. Without labelled rows the
    model has no classes. The driver takes the texts partition by partition.
    """
    rows = docs.where(F.col(label_col).isNotNull() & ~out_of_fold & (F.octet_length(text_col) <= max_bytes) & F.col(text_col).rlike(r"\p{L}"))
    rows = rows.select(F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"))
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # one row a language
    if not sizes:
        return fit([], [])
    quota = max(8, max_rows // len(sizes))
    rates = {k: int(min(1.0, quota / n) * 2**52) for k, n in sizes.items()}
    rate = F.create_map(*[F.lit(x) for kv in rates.items() for x in kv])[F.col("label")]
    picked = rows.where(F.shiftrightunsigned("h", 12) < rate).groupBy("h", "label").agg(F.min("text").alias("text"))
    got = sorted(((r["h"], r["label"], r["text"]) for r in picked.toLocalIterator(prefetchPartitions=True)))
    return fit([t.lower().encode("utf-8", "replace") for _, _, t in got], [y for _, y, _ in got])


def identify(docs: DataFrame, model: ByteCNN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` per row; ``und`` with score 0 if the text is null or has no letter.

    Whole texts are read, in batches of windows of bounded size. Repeated rows come
    back as often as they came. A model without classes says ``und`` of everything. An
    empty table gives no rows; other columns are not read, so their names can't clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few kilobytes

    def run(batches):
        import pyarrow as pa

        net = shared.value
        for b in batches:
            texts = b.column(0).to_pylist()
            total = np.zeros((len(texts), len(net.classes)))
            known = [bool(net.classes) and t is not None and _LETTER.search(t) is not None for t in texts]
            todo: list[int] = []
            size = 0

            def work():
                x, owner, held = windows([texts[i].lower().encode("utf-8", "replace") for i in todo])
                p = net.predict(x) * held[:, None]
                np.add.at(total, np.asarray(todo)[owner], p)

            for i, t in enumerate(texts):
                if known[i]:
                    todo.append(i)
                    size += len(t)
                    if size > 500_000:
                        work()
                        todo, size = [], 0
            if todo:
                work()
            share = total / np.maximum(total.sum(1, keepdims=True), 1e-9)
            best = share.argmax(1) if net.classes else np.zeros(len(texts), int)
            pred = [net.classes[best[i]] if known[i] else "und" for i in range(len(texts))]
            score = [float(min(1.0, share[i, best[i]])) if known[i] else 0.0 for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[id_col, "lang_pred", "score"])

    out = docs.select(F.col(text_col).cast("string").alias("__text"), id_col)
    return out.mapInArrow(run, f"`{id_col}` {out.schema.fields[1].dataType.simpleString()}, lang_pred string, score double")
