"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover the whole document. Bytes are
embedded, learned filters slide over each chunk, every filter is max-pooled within its chunk,
the pooled values are averaged over the chunks and a small dense layer and a logistic unit
make one probability of them.

Fitting takes at most ``MAX_ROWS`` labelled rows of each class (those of the smallest hash of
their id; of several rows of one id the one of the smallest text hash) and reads every chunk of
them. The driver holds these rows' whole texts, however large the corpus, and the windows of
``AT_ONCE`` chunks. Scoring reads every chunk of every text in one pass without a shuffle. Only
bytes of the text enter a score.

Defined results: a null text counts as empty and is scored like one chunk of padding;
repeated rows each get a row; a null doc_id keeps its row and held_out false; an empty table
gives no rows; labels that are null or neither 0 nor 1, or whose document is missing, are not
used; with labels of one class only (or none) the score is the share of good labels (one half
without any); extra columns are ignored by ``score`` and kept as they are by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.llm.common import carried, id_and_text

#: Labelled rows of each class that fitting may use, and chunks whose windows it holds at once.
MAX_ROWS, AT_ONCE = 1500, 1024
CHUNK, HOP, WIDTH, STRIDE, DIMS, FILTERS, DENSE = 256, 192, 8, 4, 8, 32, 16
PLACES = (CHUNK - WIDTH) // STRIDE + 1
#: Weight of label 1 in fitting: above one half, since a lost clean document costs more than a kept bad one.
GOOD_SHARE = 0.6
EPOCHS, LEAST_STEPS, BATCH, RATE, DECAY = 14, 500, 48, 4e-3, 1e-4
#: Chunks scored at once.
_ROWS = 4096


@dataclass
class Network:
    embed: np.ndarray  # 256 x DIMS
    filters: np.ndarray  # WIDTH * DIMS x FILTERS
    bias: np.ndarray  # FILTERS
    dense: np.ndarray  # FILTERS + 1 x DENSE; the last row is the intercept
    out: np.ndarray  # DENSE + 1; the last is the intercept

    @classmethod
    def start(cls, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(draw(256, DIMS, scale=0.5), draw(WIDTH * DIMS, FILTERS, scale=0.15), np.zeros(FILTERS, np.float32), draw(FILTERS + 1, DENSE, scale=0.2), draw(DENSE + 1, scale=0.2))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.dense, self.out]

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        """chunks (n, CHUNK) to the embedded windows (n, PLACES, WIDTH * DIMS)."""
        flat = self.embed[chunks].reshape(len(chunks), CHUNK * DIMS)
        views = np.lib.stride_tricks.sliding_window_view(flat, WIDTH * DIMS, axis=1)
        return views[:, :: STRIDE * DIMS]

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        out = np.empty((len(chunks), FILTERS), np.float32)
        for at in range(0, len(chunks), 256):
            wide = np.ascontiguousarray(self.windows(chunks[at : at + 256])).reshape(-1, WIDTH * DIMS)
            out[at : at + 256] = (wide @ self.filters).reshape(-1, PLACES, FILTERS).max(axis=1)
        return np.maximum(out + self.bias, 0)

    def hidden(self, mean: np.ndarray) -> np.ndarray:
        return np.maximum(mean @ self.dense[:-1] + self.dense[-1], 0)

    def probability(self, mean: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.hidden(mean).astype(float) @ self.out[:-1] + self.out[-1], -60, 60)))


def cut(text: str) -> np.ndarray:
    """The chunks of a text's bytes: ``HOP`` apart, padded with byte 0, at least one."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, -(-(len(data) - CHUNK) // HOP) + 1)
    padded = np.zeros((n - 1) * HOP + CHUNK, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::HOP]


def gradients(net: Network, texts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The mean weighted log loss of a batch of texts (the chunks of each) and its gradient by each of the network's parts."""
    many = np.array([len(t) for t in texts])
    chunks, of = np.concatenate(texts), np.repeat(np.arange(len(texts)), many)
    best, top = np.empty((len(chunks), FILTERS), np.uint8), np.empty((len(chunks), FILTERS), net.filters.dtype)
    for lo in range(0, len(chunks), 256):
        wide = np.ascontiguousarray(net.windows(chunks[lo : lo + 256])).reshape(-1, WIDTH * DIMS)
        made = (wide @ net.filters).reshape(-1, PLACES, FILTERS)
        best[lo : lo + 256] = made.argmax(axis=1)
        top[lo : lo + 256] = made.max(axis=1)
    hidden = np.maximum(top + net.bias, 0)
    mean = np.zeros((len(texts), FILTERS), hidden.dtype)
    np.add.at(mean, of, hidden)
    mean /= many[:, None]
    p = net.probability(mean)
    loss = float((-weight * np.log(np.where(labels == 1, p, 1 - p))).sum() / len(texts))
    error = ((p - labels) * weight / len(texts)).astype(mean.dtype)
    inner = net.hidden(mean)
    d_out = np.append(error @ inner, error.sum())
    d_inner = error[:, None] * net.out[:-1] * (inner > 0)
    d_dense = np.concatenate([mean.T @ d_inner, d_inner.sum(axis=0, keepdims=True)])
    d_top = (d_inner @ net.dense[:-1].T / many[:, None])[of] * (hidden > 0)
    d_filters, d_embed = np.zeros_like(net.filters), np.zeros_like(net.embed)
    for lo in range(0, len(chunks), AT_ONCE):  # a long text's windows are never held together
        part, own = chunks[lo : lo + AT_ONCE], d_top[lo : lo + AT_ONCE]
        rows = np.arange(len(part))[:, None, None]
        bytes_at = part[rows, STRIDE * best[lo : lo + AT_ONCE, :, None].astype(np.int64) + np.arange(WIDTH)]  # chunk, filter, WIDTH
        d_filters += np.einsum("cf,cfk->kf", own, net.embed[bytes_at].reshape(len(part), FILTERS, -1))
        d_windows = (own[:, :, None] * net.filters.T[None]).reshape(-1, DIMS)
        d_embed += np.stack([np.bincount(bytes_at.ravel(), d_windows[:, k], 256) for k in range(DIMS)], axis=1).astype(d_embed.dtype)
    return loss, [d_embed, d_filters, d_top.sum(axis=0), d_dense, d_out]


def fit(texts: list[np.ndarray], labels: np.ndarray, good_share: float | None = None, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Adam on the mean log loss, classes weighted so that label 1 has ``good_share`` (as they come if None).

    ``texts`` holds the chunks of each.
    """
    net, rng = Network.start(seed), np.random.default_rng(seed)
    labels = labels.astype(np.float32)
    share = float(labels.mean()) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        net.out[:] = 0
        net.out[-1] = {0.0: -60.0, 1.0: 60.0}.get(share, 0.0)
        return net
    good_share = share if good_share is None else good_share
    weight = np.where(labels == 1, good_share / share, (1 - good_share) / (1 - share)).astype(np.float32)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()]
    in_epoch = -(-len(texts) // BATCH)
    epochs = max(epochs, -(-LEAST_STEPS // in_epoch))  # few rows are gone through more often
    step, steps = 0, epochs * in_epoch
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            _, found = gradients(net, [texts[i] for i in own], labels[own], weight[own])
            step += 1
            for p, g, (m, v) in zip(net.parts(), found, moments, strict=True):
                g = g.astype(np.float32) + DECAY * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def _held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Network:
    """Fit on labelled rows whose ``crc32(doc_id as text) mod 3`` is not 1; at most ``max_rows`` of each class."""
    own = labels.where(~_held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("quality"), F.xxhash64("doc_id").alias("h"))
    parts = [own.where(F.col("quality") == q).orderBy("h", "doc_id").limit(max_rows) for q in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    found = (
        id_and_text(documents)
        .join(F.broadcast(chosen), "doc_id")  # at most 2 * max_rows rows
        .groupBy("quality", "h")  # doc_ids may repeat: the row of the smallest text hash
        .agg(F.min(F.struct(F.xxhash64("text").alias("t"), "text")).alias("least"))
        .select("quality", "h", "least.text")
    )
    rows = sorted((r.h, r.quality, r.text) for r in found.collect())  # at most 2 * max_rows rows
    return fit([cut(text) for _, _, text in rows], np.array([q for _, q, _ in rows]), GOOD_SHARE)


def _scores(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, many = np.zeros((len(batch), FILTERS)), np.ones(len(batch))
            held: list[np.ndarray] = []
            of: list[int] = []
            size = 0

            def flush() -> None:
                nonlocal held, of, size
                if held:
                    pooled = net.pooled(np.concatenate(held))
                    np.add.at(sums, np.repeat(of, [len(h) for h in held]), pooled)
                held, of, size = [], [], 0

            for i, text in enumerate(batch.column("text")):
                chunks = cut(text.as_py() or "")
                many[i] = len(chunks)
                for at in range(0, len(chunks), _ROWS):
                    held.append(chunks[at : at + _ROWS])
                    of.append(i)
                    size += len(held[-1])
                    if size >= _ROWS:
                        flush()
            flush()
            score = net.probability(sums / many[:, None])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=[batch.schema.names[0], "score"])

    return run


def _scored(df: DataFrame, net: Network) -> DataFrame:
    name, kind = df.columns[0], df.schema[0].dataType.simpleString()
    return df.mapInArrow(_scores(net), f"`{name}` {kind}, score double")


def score(df: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row."""
    return _scored(id_and_text(df, id_col, text_col), net).select(
        "doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_good(df: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that score one half or more, columns unchanged."""
    return _scored(carried(df, text_col), net).where("score >= 0.5").select("row.*")
