"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into chunks of ``CHUNK`` bytes that overlap by the
filter width, from its first byte to its last. Learned filters slide over every
chunk; each filter's maximum is taken per chunk, the chunk maxima are pooled
over the document (mean and maximum), and one logistic unit combines them into
a probability. The filter response of a position is a sum of table rows (one
row per offset and byte value), so a block is a few gathers and additions.

The network is fitted on a bounded sample of labelled rows (``max_rows``, at
most ``max_chunks`` evenly spaced chunks of each) on the driver; its weights
(about 130 KB) go to the executors in the task closure. Every whole text is
scored in one Arrow pass without a shuffle.

Edge cases: null and empty texts are one chunk of padding; byte 0 counts as
padding; without any labelled row, or with one class only, every score is that
class's share (0.5 without rows); a null doc_id is not held out; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bourse.llm import textcols as T
from bourse.llm.sampling import labelled_sample

CHUNK, WIDTH, STRIDE, FILTERS = 256, 8, 2, 16


def chunk_rows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of CHUNK + WIDTH bytes (0 beyond the text) and chunks per document."""
    n_chunks = np.maximum(1, -(-np.diff(off) // CHUNK))
    doc = np.repeat(np.arange(len(off) - 1), n_chunks)
    first = np.cumsum(n_chunks) - n_chunks
    start = off[doc] + (np.arange(len(doc)) - first[doc]) * CHUNK
    at = start[:, None] + np.arange(CHUNK + WIDTH)
    padded = np.append(data, np.uint8(0))
    rows = padded[np.minimum(at, len(data))]
    rows[at >= off[doc + 1][:, None]] = 0
    return rows, n_chunks


def convolve(rows: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Filter responses (chunks, positions, filters)."""
    z = table[0][rows[:, 0:CHUNK:STRIDE]]
    for w in range(1, WIDTH):
        z += table[w][rows[:, w:w + CHUNK:STRIDE]]
    return z


def pooled(peak: np.ndarray, n_chunks: np.ndarray) -> np.ndarray:
    """Mean and maximum of the chunk maxima of each document."""
    at = np.cumsum(n_chunks) - n_chunks
    return np.hstack([np.add.reduceat(peak, at) / n_chunks[:, None], np.maximum.reduceat(peak, at)])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def probabilities(data: np.ndarray, off: np.ndarray, model: dict) -> np.ndarray:
    """Probability of label 1 of every document of a block."""
    if model.get("constant") is not None:
        return np.full(len(off) - 1, model["constant"])
    out = np.empty(len(off) - 1)
    for i, j, d, o in T.blocks(data, off, 1 << 17):
        rows, n_chunks = chunk_rows(d, o)
        peak = np.empty((len(rows), FILTERS), np.float32)
        for k in range(0, len(rows), 512):              # a long document goes through in parts
            peak[k:k + 512] = convolve(rows[k:k + 512], model["table"]).max(1)
        x = pooled(np.maximum(peak + model["bias"], 0), n_chunks)
        out[i:j] = sigmoid(x @ model["weight"] + model["offset"])
    return out


def train(texts: list[bytes], labels: list[int], *, max_chunks: int = 64, epochs: int = 10, batch: int = 64,
          rate: float = 0.02, seed: int = 3) -> dict:
    """Fit the network by Adam on the log loss."""
    y = np.array(labels, np.float64)
    if len(y) == 0 or y.min() == y.max():
        return {"constant": float(y.mean()) if len(y) else 0.5}
    rng = np.random.default_rng(seed)
    chunks = []
    for t in texts:
        rows = chunk_rows(np.frombuffer(t, np.uint8), np.array([0, len(t)], np.int64))[0]
        if len(rows) > max_chunks:
            rows = rows[np.linspace(0, len(rows) - 1, max_chunks).astype(int)]
        chunks.append(rows)
    table = rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32)
    table[:, 0] = 0
    p = {"table": table, "bias": np.zeros(FILTERS, np.float32), "weight": rng.normal(0, 0.3, 2 * FILTERS),
         "offset": np.array(np.log(y.mean() / (1 - y.mean())))}
    m1 = {k: np.zeros_like(v) for k, v in p.items()}
    m2 = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for b in range(0, len(y), batch):
            pick = order[b:b + batch]
            n = np.array([len(chunks[i]) for i in pick])
            rows = np.concatenate([chunks[i] for i in pick])
            z = convolve(rows, p["table"])
            pos = z.argmax(1)                                          # (chunks, filters)
            raw = np.take_along_axis(z, pos[:, None], 1)[:, 0] + p["bias"]
            peak = np.maximum(raw, 0)
            x = pooled(peak, n)
            g = (sigmoid(x @ p["weight"] + p["offset"]) - y[pick]) / len(pick)
            doc = np.repeat(np.arange(len(pick)), n)
            down = g[doc][:, None] * (p["weight"][:FILTERS] / n[doc][:, None]
                                      + p["weight"][FILTERS:] * (peak >= x[doc][:, FILTERS:]))
            down = np.where(raw > 0, down, 0.05 * down)                # a small slope keeps dead filters learning
            f = np.broadcast_to(np.arange(FILTERS), pos.shape)
            grad = {"weight": x.T @ g + 1e-4 * p["weight"], "offset": g.sum(), "bias": down.sum(0)}
            flat = []
            for w in range(WIDTH):
                byte = np.take_along_axis(rows, pos * STRIDE + w, 1).astype(np.int64)
                flat.append(np.bincount((byte * FILTERS + f).ravel(), down.ravel(), 256 * FILTERS))
            grad["table"] = np.array(flat).reshape(WIDTH, 256, FILTERS)
            grad["table"][:, 0] = 0
            step += 1
            lr = rate * (1 - epoch / epochs)
            for k in p:
                m1[k] = 0.9 * m1[k] + 0.1 * grad[k]
                m2[k] = 0.99 * m2[k] + 0.01 * grad[k] ** 2
                p[k] = (p[k] - lr * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.99 ** step)) + 1e-8)
                        ).astype(p[k].dtype)
    return p


def fit_quality(docs: DataFrame, labels: DataFrame, keep, *, max_rows: int = 4000, **options) -> dict:
    """The network fitted on at most ``max_rows`` labelled rows for which ``keep`` holds."""
    rows = labelled_sample(docs, labels, "quality", keep, max_rows).orderBy("doc_id", "text").collect()
    return train([r["text"].encode() for r in rows], [r["y"] for r in rows], **options)


def score_quality(docs: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """``docs`` with a column of probabilities; every other column stays."""
    if name in docs.columns:
        raise ValueError(f"the input already has a column {name!r}")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, off = T.column(batch, "text")
            score = pa.array(probabilities(data, off, model), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, score], names=[*batch.schema.names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(T.released(run), f"{kinds}, `{name}` double")


def quality_scores(docs: DataFrame, labels: DataFrame, keep, held_out, *, threshold: float = 0.3, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score and predicted."""
    model = fit_quality(docs, labels, keep, **options)
    cols = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # the texts stay in the Python pass; only the id and the score come back
    return (score_quality(cols, model)
            .select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))
