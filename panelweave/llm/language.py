"""Language identification by a convolutional network over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.corpus import apart, id_crc
from panelweave.llm.texts import blocks, utf8

LENGTH = 256  # bytes of a window
EMBEDDING = 8
WIDTHS = (2, 3, 4)
FILTERS = 16
ROWS_PER_LANGUAGE = 600  # bound of the training sample
WINDOWS_PER_ROW = 4
EPOCHS = 12
WINDOWS_TOGETHER = 256


@dataclass
class ByteNet:
    """Byte embedding, filters of several widths, max pooling over the window, softmax."""

    languages: list[str]
    embedding: np.ndarray  # 257 x E; the last row stands for the bytes after the end
    filters: list[np.ndarray]  # per width: (width * E) x F
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: np.ndarray

    def hidden(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        x = self.embedding[windows]
        pooled, where = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.biases):
            n, length, e = x.shape
            y = np.empty((n, length - w + 1, f.shape[1]), np.float32)
            y[:] = b
            for j in range(w):
                y += (x[:, j : length - w + 1 + j].reshape(-1, e) @ f[j * e : (j + 1) * e]).reshape(n, length - w + 1, -1)
            top = y.argmax(axis=1) if where is not None else None
            where.append(top)
            pooled.append(np.maximum(np.take_along_axis(y, top[:, None], 1)[:, 0], 0))
        return np.concatenate(pooled, axis=1), where, x

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = self.hidden(windows)[0] @ self.weights + self.bias
        z = z - z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def untrained(languages: list[str], seed: int = 7) -> ByteNet:
    rng = np.random.default_rng(seed)
    f32 = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    embedding = f32(257, EMBEDDING, scale=0.5)
    embedding[256] = 0
    return ByteNet(
        languages, embedding,
        [f32(w * EMBEDDING, FILTERS, scale=(2 / (w * EMBEDDING)) ** 0.5) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        f32(FILTERS * len(WIDTHS), len(languages), scale=0.1),
        np.zeros(len(languages), np.float32),
    )


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = 7) -> ByteNet:
    """Fit by Adam on the cross entropy, in mini-batches of 64 windows."""
    net = untrained(languages, seed)
    rng = np.random.default_rng(seed)
    parts = [net.embedding, *net.filters, *net.biases, net.weights, net.bias]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), 64):
            pick = order[i : i + 64]
            got = windows[pick]
            hidden, where, x = net.hidden(got)
            z = hidden @ net.weights + net.bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), labels[pick]] -= 1
            p /= len(pick)
            back = (p @ net.weights.T) * (hidden > 0)
            grads = [np.zeros_like(net.embedding)]
            filters, biases = [], []
            for k, (w, f) in enumerate(zip(WIDTHS, net.filters)):
                d = back[:, k * FILTERS : (k + 1) * FILTERS]
                at = where[k][:, :, None] + np.arange(w)  # rows x filters x width
                seen = x[np.arange(len(pick))[:, None, None], at].reshape(len(pick), FILTERS, -1)
                filters.append(np.einsum("nf,nfe->ef", d, seen))
                biases.append(d.sum(axis=0))
                into = (d[:, :, None] * f.T[None]).reshape(-1, EMBEDDING)
                np.add.at(grads[0], got[np.arange(len(pick))[:, None, None], at].reshape(-1), into)
            grads[0][256] = 0
            grads += [*filters, *biases, hidden.T @ p, p.sum(axis=0)]
            step += 1
            for q, g, m, v in zip(parts, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= 0.004 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    return net


def cut(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Windows of fixed length that cover every byte of every text once, and their text. The
    last window of a text is filled up."""
    sizes = np.diff(offsets)
    counts = -(-sizes // length)
    owner = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = offsets[owner] + number * length
    windows = np.full((len(owner), length), 256, np.int16)
    full = begin + length <= offsets[owner + 1]
    if full.any():
        windows[full] = np.lib.stride_tricks.sliding_window_view(data, length)[begin[full]]
    for i in np.flatnonzero(~full).tolist():
        rest = data[begin[i] : offsets[owner[i] + 1]]
        windows[i, : len(rest)] = rest
    return windows, owner


def fit(docs: DataFrame, may_learn: Column, rows_per_language: int = ROWS_PER_LANGUAGE, text: str = "text", lang: str = "lang") -> ByteNet | None:
    """Train on a bounded sample: of each language the ``rows_per_language`` rows that come first
    by a hash of their id, and of each up to four windows spread over the text.

    Only that sample reaches the driver; rank-limited windows keep a bounded number of rows per
    language and task before they are shuffled. None when there is nothing to learn from.
    """
    n = WINDOWS_PER_ROW
    usable = docs.filter(may_learn & F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0))
    piece = [F.substring(F.col(text), (F.length(text) * F.lit(i) / F.lit(n)).cast("int") + 1, F.lit(LENGTH)) for i in range(n)]
    slim = usable.select(F.col(lang).alias("lang"), F.xxhash64("doc_id").alias("h"), F.array(*piece).alias("pieces"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    rows = slim.withColumn("_r", rank).filter(F.col("_r") <= rows_per_language).collect()
    rows.sort(key=lambda r: (r["lang"], r["h"]))
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return None
    raw, labels = [], []
    for r in rows:
        for p in dict.fromkeys(r["pieces"]):
            if p:
                raw.append(p.encode()[:LENGTH])
                labels.append(languages.index(r["lang"]))
    windows = np.full((len(raw), LENGTH), 256, np.int16)
    for i, b in enumerate(raw):
        windows[i, : len(b)] = np.frombuffer(b, np.uint8)
    return train(windows, np.array(labels), languages)


def predict(docs: DataFrame, net: ByteNet | None, text: str = "text") -> DataFrame:
    """Add lang_pred and score to the rows: the language with the greatest mean log probability
    over all windows of the whole text, and its share after a softmax over the languages.

    A text that is null or has no letter gets ``und`` and score 0, as does every text when
    there is no network. Narrow; windows go through the network a few hundred at a time, so a
    very long text needs no more memory than its windows. Columns of these names are replaced.
    """
    return apart(docs, [text], lambda d: _predict(d, net, text), ("lang_pred", "score"))


def _predict(docs: DataFrame, net: ByteNet | None, text: str) -> DataFrame:
    stay = [c for c in docs.columns if c not in ("lang_pred", "score")]
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    source = docs.select(*stay, letters.alias("_letters"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*stay).schema] + ["lang_pred string", "score double"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text):
            n = batch.num_rows
            names, scores = ["und"] * n, np.zeros(n)
            if net is not None:
                windows, owner = cut(*utf8(batch.column(text)))
                total = np.zeros((n, len(net.languages)))
                for i in range(0, len(windows), WINDOWS_TOGETHER):
                    np.add.at(total, owner[i : i + WINDOWS_TOGETHER], net.log_probabilities(windows[i : i + WINDOWS_TOGETHER]))
                mean = total / np.maximum(np.bincount(owner, minlength=n), 1)[:, None]
                best = mean.argmax(axis=1)
                share = np.exp(mean - mean.max(axis=1, keepdims=True))
                share = share.max(axis=1) / share.sum(axis=1)
                for i in np.flatnonzero(batch.column("_letters").to_numpy(zero_copy_only=False)).tolist():
                    names[i], scores[i] = net.languages[best[i]], share[i]
            kept = [batch.column(c) for c in stay]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*stay, "lang_pred", "score"])

    return source.mapInArrow(run, schema)


def held_out(column: str = "doc_id") -> Column:
    return id_crc(column) % 3 == 1
