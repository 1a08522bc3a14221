"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Terms of a text are hashed words, hashed trigrams of its character shapes, and how
often its word pairs repeat.  A truncated decomposition of their weights over a
bounded labelled sample spans the space; the labelled vectors are broadcast, and
every text meets all of them in blocks of exact cosine products.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainrisk.llm.arrays import SpanHash, lower, mix, text_chunks, word_spans
from chainrisk.sources.staging import stage

SHAPE_TERMS, WORD_TERMS = 2048, 2046
TERMS = SHAPE_TERMS + WORD_TERMS + 2
_REPEAT, _LENGTH = TERMS - 2, TERMS - 1
_BLOCK = 256
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[0x80:] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")


@dataclass(frozen=True)
class VoteModel:
    """Term weights, the map to latent space, and vectors, labels and weights of labelled texts."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Damped term frequencies (texts x TERMS) of whole texts."""
    n = len(offsets) - 1
    counts = np.zeros(n * TERMS, dtype=np.float32)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    if len(data) >= 3:
        shape = _SHAPE[data].astype(np.uint64)
        code = mix(shape[:-2] << np.uint64(16) | shape[1:-1] << np.uint64(8) | shape[2:]) >> np.uint64(53)
        inside = owner[:-2] == owner[2:]
        at = owner[:-2][inside] * TERMS + code[inside].astype(np.int64)
        counts += np.bincount(at, minlength=len(counts)).astype(np.float32)
    small = lower(data)
    starts, ends, first = word_spans(small, offsets)
    if len(starts):
        words = SpanHash(small)(starts, ends)
        of = np.repeat(np.arange(n), np.diff(first))
        at = of * TERMS + SHAPE_TERMS + (words % np.uint64(WORD_TERMS)).astype(np.int64)
        counts += np.bincount(at, minlength=len(counts)).astype(np.float32)
        pairs = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:] + of[1:].astype(np.uint64))
        same = of[:-1] == of[1:]
        _, lead = np.unique(pairs[same], return_index=True)
        total = np.bincount(of[1:][same], minlength=n)
        again = total - np.bincount(of[1:][same][lead], minlength=n)
        table = counts.reshape(n, TERMS)
        table[:, _REPEAT] = 64.0 * again / np.maximum(total, 1)
        table[:, _LENGTH] = np.diff(first) > 0
    return counts.reshape(n, TERMS)


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _latent(counts: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    v = _weighted(counts, idf) @ basis
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _small_chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for rows, data, offsets in text_chunks(batches):
        for at in range(0, rows.num_rows, _BLOCK):
            cut = offsets[at : at + _BLOCK + 1]
            yield rows.slice(at, _BLOCK), data[cut[0] : cut[-1]], cut - cut[0]


def _sample_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in _small_chunks(batches):
        counts = term_counts(data, offsets)
        found = [np.flatnonzero(c) for c in counts]
        yield pa.record_batch(
            [
                rows.column("label"),
                rows.column("weight"),
                pa.array([f.astype(np.int16).tobytes() for f in found], pa.binary()),
                pa.array([c[f].tobytes() for c, f in zip(counts, found)], pa.binary()),
            ],
            ["label", "weight", "terms", "counts"],
        )


def fit_votes(docs: DataFrame, labels: DataFrame, per_label: int = 1500, dims: int = 48, seed: int = 1) -> VoteModel:
    """Model from labelled documents: ``labels`` has (doc_id, label 0 or 1).

    The sample is bounded: about ``per_label`` documents of each label, by a hash of
    doc_id, and at most twice that in all; neighbours are weighted back to the shares of
    the labels.  Rows with a null id or label teach nothing; of several labels of a
    document the least counts.
    """
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    rate = F.lit(0.0)
    for label, count in totals.items():
        rate = F.when(F.col("label") == label, min(1.0, per_label / count)).otherwise(rate)
    picked = known.where(u < rate).select("doc_id", "label", F.try_divide(F.lit(1.0), rate).alias("weight"), u.alias("u"))
    picked = stage(picked.orderBy("u", "doc_id").limit(2 * per_label), "labelled")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(picked, "doc_id")
    rows = texts.select("text", "label", "weight").mapInArrow(
        _sample_terms, "label int, weight double, terms binary, counts binary"
    ).limit(4 * per_label).collect()
    n = len(rows)
    counts = np.zeros((n, TERMS), dtype=np.float32)
    for k, r in enumerate(rows):
        counts[k, np.frombuffer(r.terms, np.int16)] = np.frombuffer(r.counts, np.float32)
    y = np.array([r.label for r in rows], dtype=np.float32)
    w = np.array([r.weight for r in rows], dtype=np.float32)
    present = (counts > 0).sum(axis=0)
    idf = np.log((1 + n) / (1 + present)).astype(np.float32) + 1
    x = _weighted(counts, idf)
    rank = min(dims, max(n, 1))
    draws = np.random.default_rng(seed).standard_normal((TERMS, rank + 8)).astype(np.float32)
    for _ in range(3):  # subspace iterations towards the leading right singular vectors
        draws, _ = np.linalg.qr(x.T @ (x @ draws)) if n else (draws, None)
    _, _, vt = np.linalg.svd(x @ draws, full_matrices=False) if n else (None, None, np.eye(rank + 8, dtype=np.float32))
    basis = (draws @ vt.T)[:, :rank].astype(np.float32)
    return VoteModel(idf, basis, _latent(counts, idf, basis), y, w, float((w * y).sum() / w.sum()) if n else 0.5)


def _vote(batches: Iterable[pa.RecordBatch], shared: object, neighbours: int, sharpness: float) -> Iterator[pa.RecordBatch]:
    m: VoteModel = shared.value
    k = min(neighbours, len(m.labels))
    for rows, data, offsets in _small_chunks(batches):
        n = rows.num_rows
        votes, total = np.full(n, 1e-6 * m.prior), np.full(n, 1e-6)
        if k:
            cosine = _latent(term_counts(data, offsets), m.idf, m.basis) @ m.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k] if k < cosine.shape[1] else np.tile(np.arange(k), (n, 1))
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0.0).astype(np.float64) ** sharpness * m.weights[near]
            votes += (weight * m.labels[near]).sum(axis=1)
            total += weight.sum(axis=1)
        kept = [c for c in rows.schema.names if c != "text"]
        score = pa.array(np.clip(votes / total, 0, 1), pa.float64())
        yield pa.record_batch([*(rows.column(c) for c in kept), score], [*kept, "score"])


def vote_scores(
    docs: DataFrame, model: VoteModel, carry: tuple[str, ...] = ("doc_id",), neighbours: int = 15, sharpness: float = 8.0
) -> DataFrame:
    """The ``carry`` columns with ``score``: share of label 1 among the nearest labelled texts.

    Votes weigh cosine ** sharpness.  A text without terms (null, empty or blank) gets the
    share of label 1 in the labelled rows; so does every text, 0.5, if there are none.
    Only the text is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*(F.col(c).alias(f"c_{c}") for c in carry), F.col("text").cast("string").alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`c_{c}` {kinds[f'c_{c}']}" for c in carry)
    scored = rows.mapInArrow(lambda it: _vote(it, shared, neighbours, sharpness), f"{schema}, score double")
    return scored.select(*(F.col(f"c_{c}").alias(c) for c in carry), "score")
