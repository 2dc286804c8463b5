"""Quality of whole texts by a byte-level convolutional network in numpy.

A text is its UTF-8 bytes, cut into overlapping chunks that cover all of it.  A byte
becomes a learned vector plus one channel that says whether the last bytes have stood in
the chunk before.  Learned filters slide over the chunk; the answers are max-pooled over
short segments, and the segments' maxima enter twice: as their mean (how common a pattern
is) and as their maximum (whether it occurs at all).  Chunks combine the same way, and a
small dense layer turns the pooled answers into one probability.

Fitting uses whole texts of a bounded sample on the driver: ``rows_per_class`` documents of each class, drawn
among those of at most ``text_bytes``.  Scoring runs inside the map tasks over every byte of every text,
in blocks of bounded size, without a shuffle.

Cases: null and empty texts are scored as one empty chunk; very long texts go through in
blocks; equal texts get equal scores; an empty table gives no rows; without labels of both
classes every score is the share of label 1 (0.5 without labels); other columns pass
through, a column named like the result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.labels import labelled_sample

CHUNK, STEP = 512, 480  # bytes of a chunk, and from one chunk to the next
VECTOR, WIDTH, STRIDE, FILTERS, SEGMENT, HIDDEN = 5, 8, 2, 24, 32, 16
REPEAT_BYTES = 12
BLOCK = 256  # chunks scored at a time

Model = dict[str, np.ndarray]


def chunks_of(data: bytes) -> list[bytes]:
    """Overlapping chunks that cover all of ``data``; one empty chunk if there is none."""
    starts = range(0, max(len(data) - (CHUNK - STEP), 1), STEP)
    return [data[i : i + CHUNK] for i in starts]


def as_matrix(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte numbers (0 pads, so bytes count from 1) and the lengths of the chunks."""
    ids = np.zeros((len(chunks), CHUNK), np.int16)
    lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
    flat = np.frombuffer(b"".join(chunks), np.uint8)
    ids[np.arange(CHUNK) < lengths[:, None]] = flat.astype(np.int16) + 1
    return ids, lengths


def repeats(ids: np.ndarray) -> np.ndarray:
    """1 where the last ``REPEAT_BYTES`` bytes have stood earlier in the same chunk."""
    rolled = np.zeros(ids.shape, np.uint64)
    for k in range(REPEAT_BYTES):
        shifted = ids[:, REPEAT_BYTES - 1 - k : CHUNK - k].astype(np.uint64)
        rolled[:, REPEAT_BYTES - 1 :] = rolled[:, REPEAT_BYTES - 1 :] * np.uint64(0x9E3779B97F4A7C15 | 1) + shifted
    short = (rolled >> np.uint64(48)).astype(np.uint16)
    order = np.argsort(short, axis=1, kind="stable")
    by_order = np.take_along_axis(rolled, order, 1)
    again = np.zeros(ids.shape, bool)
    again[:, 1:] = by_order[:, 1:] == by_order[:, :-1]
    out = np.zeros(ids.shape, np.float32)
    np.put_along_axis(out, order, again.astype(np.float32), 1)
    out[ids == 0] = 0
    out[:, : REPEAT_BYTES - 1] = 0
    return out


def _inputs(model: Model, ids: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Rows of ``WIDTH`` byte vectors for each place of the filters."""
    x = np.empty((*ids.shape, VECTOR + 1), np.float32)
    x[..., :VECTOR] = model["bytes"][ids]
    x[..., VECTOR] = seen
    view = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1)[:, ::STRIDE]
    return np.ascontiguousarray(view.transpose(0, 1, 3, 2)).reshape(len(ids), view.shape[1], -1)


def _places() -> int:
    return (CHUNK - WIDTH) // STRIDE + 1


def _segments(lengths: np.ndarray) -> np.ndarray:
    """Which pooled segments of each chunk hold bytes."""
    count = -(-_places() // SEGMENT)
    return (np.arange(count) * SEGMENT * STRIDE < np.maximum(lengths, 1)[:, None]).astype(np.float32)


def _filter(model: Model, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maxima of the filters' answers in each segment, and where they stand."""
    n, places, _ = rows.shape
    answers = np.maximum(rows.reshape(n * places, -1) @ model["filters"] + model["shift"], 0)
    count = -(-places // SEGMENT)
    padded = np.zeros((n, count * SEGMENT, FILTERS), np.float32)
    padded[:, :places] = answers.reshape(n, places, FILTERS)
    padded = padded.reshape(n, count, SEGMENT, FILTERS)
    at = padded.argmax(2)
    return np.take_along_axis(padded, at[:, :, None], 2)[:, :, 0], at


def pool(model: Model, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per chunk: sums of segment maxima, the number of segments, and the largest maxima."""
    tops, _ = _filter(model, _inputs(model, ids, repeats(ids)))
    held = _segments(lengths)
    return np.concatenate(
        [(tops * held[..., None]).sum(1), held.sum(1, keepdims=True), (tops * held[..., None]).max(1)], 1
    )


def combine(model: Model, total: np.ndarray, count: np.ndarray, largest: np.ndarray) -> np.ndarray:
    pooled = np.concatenate([total / count, largest], 1)
    hidden = np.maximum(pooled @ model["dense"] + model["dense_shift"], 0)
    return 1 / (1 + np.exp(-(hidden @ model["out"] + model["out_shift"])))[:, 0]


def score_texts(model: Model, texts: list[str | None]) -> np.ndarray:
    """A probability for each text, computed in blocks of at most ``BLOCK`` chunks."""
    n = len(texts)
    total, count = np.zeros((n, FILTERS), np.float32), np.zeros((n, 1), np.float32)
    largest = np.zeros((n, FILTERS), np.float32)
    owners: list[int] = []
    block: list[bytes] = []

    def flush() -> None:
        found = pool(model, *as_matrix(block))
        at = np.array(owners)
        np.add.at(total, at, found[:, :FILTERS])
        np.add.at(count, at, found[:, FILTERS : FILTERS + 1])
        np.maximum.at(largest, at, found[:, FILTERS + 1 :])
        owners.clear()
        block.clear()

    for i, text in enumerate(texts):
        for chunk in chunks_of((text or "").encode("utf-8", "replace")):
            owners.append(i)
            block.append(chunk)
            if len(block) == BLOCK:
                flush()
    if block:
        flush()
    return combine(model, total, count, largest) if n else np.zeros(0)


def fit(
    chunks: list[bytes], owners: np.ndarray, labels: np.ndarray, epochs: int | None = None, batch: int = 32, seed: int = 5
) -> Model:
    """Fit by gradient descent (Adam).  ``owners`` maps chunks to documents, ``labels`` is 0/1 per document.

    Small samples are gone through more often, so that each fit takes a few hundred steps.
    """
    rng = np.random.default_rng(seed)
    epochs = epochs or int(np.clip(300 * batch // max(len(labels), 1), 5, 40))
    normal = lambda *shape: rng.normal(size=shape).astype(np.float32)
    wide = WIDTH * (VECTOR + 1)
    model: Model = {
        "bytes": normal(257, VECTOR) * 0.5,
        "filters": normal(wide, FILTERS) / np.float32(np.sqrt(wide)),
        "shift": np.zeros(FILTERS, np.float32),
        "dense": normal(2 * FILTERS, HIDDEN) / np.float32(np.sqrt(2 * FILTERS)),
        "dense_shift": np.zeros(HIDDEN, np.float32),
        "out": normal(HIDDEN, 1) / np.float32(np.sqrt(HIDDEN)),
        "out_shift": np.zeros(1, np.float32),
    }
    model["bytes"][0] = 0
    ids, lengths = as_matrix(chunks)
    seen = np.concatenate([repeats(ids[i : i + BLOCK]).astype(bool) for i in range(0, len(ids), BLOCK)])
    by_owner = np.argsort(owners, kind="stable")
    bounds = np.searchsorted(owners[by_owner], np.arange(len(labels) + 1))
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    step = 0
    for epoch in range(epochs):
        rate = 4e-3 * (1 - epoch / epochs) + 5e-4
        order = rng.permutation(len(labels))
        for begin in range(0, len(order), batch):
            docs = order[begin : begin + batch]
            rows = np.concatenate([by_owner[bounds[d] : bounds[d + 1]] for d in docs])
            own = np.repeat(np.arange(len(docs)), [bounds[d + 1] - bounds[d] for d in docs])
            step += 1
            for k, g in _gradients(model, ids[rows], seen[rows], lengths[rows], own, labels[docs]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                unbiased = first[k] / (1 - 0.9**step)
                model[k] -= (rate * unbiased / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
            model["bytes"][0] = 0
    return model


def _gradients(model, ids, seen, lengths, own, labels) -> Model:
    """Gradients over the chunks of some documents; inputs are built ``BLOCK`` chunks at a time, twice."""
    n = len(labels)
    blocks = [slice(i, i + BLOCK) for i in range(0, len(ids), BLOCK)]
    found = [_filter(model, _inputs(model, ids[b], seen[b])) for b in blocks]
    tops, at = (np.concatenate(x) for x in zip(*found, strict=True))
    held = _segments(lengths)[..., None]
    tops = tops * held
    count = np.zeros((n, 1), np.float32)
    np.add.at(count, own, held.sum(1))
    total = np.zeros((n, FILTERS), np.float32)
    np.add.at(total, own, tops.sum(1))
    chunk_top = tops.max(1)
    largest = np.zeros((n, FILTERS), np.float32)
    np.maximum.at(largest, own, chunk_top)
    pooled = np.concatenate([total / count, largest], 1)
    before = pooled @ model["dense"] + model["dense_shift"]
    hidden = np.maximum(before, 0)
    p = 1 / (1 + np.exp(-(hidden @ model["out"] + model["out_shift"])))

    d_out = ((p[:, 0] - labels) / n).astype(np.float32)[:, None]
    g: Model = {"out": hidden.T @ d_out, "out_shift": d_out.sum(0)}
    d_hidden = (d_out @ model["out"].T) * (before > 0)
    g["dense"], g["dense_shift"] = pooled.T @ d_hidden, d_hidden.sum(0)
    d_pooled = d_hidden @ model["dense"].T
    d_tops = ((d_pooled[:, :FILTERS] / count)[own])[:, None, :] * held
    winner = tops == largest[own][:, None, :]
    d_tops = (d_tops + winner * d_pooled[:, FILTERS:][own][:, None, :]) * (tops > 0)
    g["filters"], g["shift"] = np.zeros_like(model["filters"]), np.zeros_like(model["shift"])
    g["bytes"] = np.zeros_like(model["bytes"])
    for b in blocks:
        _add_gradients(g, model, ids[b], seen[b], at[b], d_tops[b])
    return g


def _add_gradients(g: Model, model: Model, ids: np.ndarray, seen: np.ndarray, at: np.ndarray, d_tops: np.ndarray) -> None:
    """Only the place that won its segment hears of the error."""
    rows = _inputs(model, ids, seen)
    c, s, f = np.nonzero(d_tops)
    place = s * SEGMENT + at[c, s, f]
    places = rows.shape[1]
    d_answers = np.zeros((len(ids) * places, FILTERS), np.float32)
    d_answers[c * places + place, f] = d_tops[c, s, f].astype(np.float32)
    flat = rows.reshape(len(ids) * places, -1)
    touched = np.unique(c * places + place)
    d_some = d_answers[touched]
    g["filters"] += flat[touched].T @ d_some
    g["shift"] += d_some.sum(0)
    d_rows = (d_some @ model["filters"].T).reshape(len(touched), WIDTH, VECTOR + 1)[..., :VECTOR]
    byte = ids[touched // places][
        np.arange(len(touched))[:, None], (touched % places)[:, None] * STRIDE + np.arange(WIDTH)
    ]
    for v in range(VECTOR):
        g["bytes"][:, v] += np.bincount(byte.ravel(), d_rows[..., v].ravel(), 257).astype(np.float32)


def fit_model(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    rows_per_class: int = 1200,
    text_bytes: int = 1 << 16,
) -> Model | float:
    """Learn from a bounded sample; a single number if there are not two classes to learn."""
    # Both bound the rows of the sample; no text of it is cut.
    short = docs.select(doc_id, text).filter(F.coalesce(F.octet_length(text), F.lit(0)) <= text_bytes)
    sample = labelled_sample(short, labels, label, rows_per_class, doc_id, text)
    rows = sample.select(doc_id, "__label", F.col(text).alias("t")).collect()
    rows.sort(key=lambda r: r[doc_id])
    known = np.array([r["__label"] for r in rows], np.float32)
    if not len(known) or known.min() == known.max():
        return float(known.mean()) if len(known) else 0.5
    every = [chunks_of((r["t"] or "").encode("utf-8", "replace")) for r in rows]
    return fit([c for chunks in every for c in chunks], np.repeat(np.arange(len(rows)), list(map(len, every))), known)


def score(docs: DataFrame, model: Model | float, text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability of label 1 for every whole text."""
    if isinstance(model, float):
        return docs.withColumn(out, F.lit(model))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some 40 kB, whatever the data

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(score_texts(shared.value, list(texts)).astype(np.float64))

    return docs.withColumn(out, probability(F.col(text)))
