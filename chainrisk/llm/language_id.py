"""Language identification with string kernels.

The kernel of two texts counts the character n-grams, of all lengths from 1 to
``max_gram``, that are present in both, and is scaled to 1 for equal sets.  Grams
are hashed to ``buckets``.  A Nystrom map onto landmark texts turns it into a few
hundred numbers per text; one ridge regression per language is fitted on those.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainrisk.llm.arrays import CHUNK_BYTES, mix, text_arrays
from chainrisk.sources.staging import stage

UNKNOWN = "und"
_BLOCK = 64


@dataclass(frozen=True)
class KernelModel:
    """Landmark presences (buckets x landmarks), their sizes, and weights (landmarks x languages)."""

    languages: tuple[str, ...]
    landmarks: np.ndarray
    sizes: np.ndarray
    weights: np.ndarray
    max_gram: int

    @property
    def buckets(self) -> int:
        return len(self.landmarks)


def held_out(folds: int) -> Column:
    """Whether a row is kept from training: crc32 of doc_id as text divides by ``folds`` (null id: yes)."""
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8")) % folds == 0


def _presence(text: np.ndarray, max_gram: int, buckets: int, out: np.ndarray) -> None:
    """Mark the buckets of all grams of a UTF-8 text; long texts go in overlapping pieces of bounded size."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    for at in range(0, len(text), CHUNK_BYTES):
        piece = text[at : at + CHUNK_BYTES + 4 * max_gram]
        while len(piece) and at + len(piece) < len(text) and text[at + len(piece)] & 0xC0 == 0x80:
            piece = piece[:-1]
        skip = int(np.argmax(piece & 0xC0 != 0x80)) if len(piece) else 0
        points = np.frombuffer(piece[skip:].tobytes().decode("utf-8", "ignore").encode("utf-32-le"), np.uint32)
        code = np.zeros(len(points), dtype=np.uint64)
        for n in range(1, max_gram + 1):
            if len(points) < n:
                break
            code = code[: len(points) - n + 1] * np.uint64(0x1F123BB5) + points[n - 1 :].astype(np.uint64) + np.uint64(1)
            out[mix(code + np.uint64(n << 56)) >> shift] = 1


def _presences(data: np.ndarray, offsets: np.ndarray, max_gram: int, buckets: int) -> np.ndarray:
    rows = np.zeros((len(offsets) - 1, buckets), dtype=np.float32)
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        _presence(data[a:b], max_gram, buckets, rows[k])
    return rows


def _blocks(
    batches: Iterable[pa.RecordBatch], column: str = "text"
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, _BLOCK):
            rows = batch.slice(at, _BLOCK)
            yield rows, *text_arrays(rows.column(column))


def _kernels(presences: np.ndarray, landmarks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    own = presences.sum(axis=1)
    return (presences @ landmarks) / np.sqrt(np.maximum(own, 1)[:, None] * np.maximum(sizes, 1)[None, :])


def _sparse(batches: Iterable[pa.RecordBatch], max_gram: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in _blocks(batches):
        found = [np.flatnonzero(p).astype(np.int32).tobytes() for p in _presences(data, offsets, max_gram, buckets)]
        yield pa.record_batch([rows.column("lang"), pa.array(found, pa.binary())], ["lang", "grams"])


def _features(batches: Iterable[pa.RecordBatch], shared: object, max_gram: int) -> Iterator[pa.RecordBatch]:
    landmarks, sizes = shared.value
    for rows, data, offsets in _blocks(batches):
        k = _kernels(_presences(data, offsets, max_gram, len(landmarks)), landmarks, sizes)
        yield pa.record_batch([rows.column("lang"), pa.array([x.astype(np.float32).tobytes() for x in k], pa.binary())], ["lang", "kernel"])


def _has_letter(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def fit_languages(
    docs: DataFrame,
    per_language: int = 1000,
    landmarks_per_language: int = 48,
    full_languages: int = 64,
    max_gram: int = 4,
    buckets: int = 1 << 14,
    ridge: float = 1e-3,
) -> KernelModel:
    """Fit on (text, lang) rows; those with a null in either, or without a letter, teach nothing.

    Every language is learned.  The sample is bounded by texts of a language: those whose
    hash is below ``per_language`` over the language's different texts, so about that many,
    and always the one of the least hash.  The first ``landmarks_per_language`` of each, by
    hash, are landmarks.  Above ``full_languages`` languages both numbers fall in inverse
    proportion to the languages, to no less than one.
    """
    spark = docs.sparkSession
    known = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where(_has_letter("text") & F.col("lang").isNotNull())
    hashed = known.withColumn("h", F.xxhash64("text"))
    u = F.pmod("h", F.lit(1 << 40)) / float(1 << 40)
    # Copies count once: shares are of the different texts of a language.
    texts = hashed.select("lang", "h").distinct()
    common = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(u).alias("least")).collect()
    fewer = min(1.0, full_languages / max(len(common), 1))
    per, heads_per = max(1, int(per_language * fewer)), max(1, int(landmarks_per_language * fewer))
    shares = [x for r in common for x in (F.lit(r.lang), F.lit(max(per / r.n, float(np.nextafter(r.least, 2.0)))))]
    share = F.create_map(*shares)[F.col("lang")] if shares else F.lit(None).cast("double")
    picked = hashed.where(u < share).dropDuplicates(["lang", "h"])
    sample = stage(picked.orderBy(u, "lang", "h"), "sample-texts")
    keys = sorted((r.lang, r.u, r.h) for r in sample.select(u.alias("u"), "lang", "h").collect())
    heads = [h for _, own in groupby(keys, key=lambda k: k[0]) for _, _, h in islice(own, heads_per)]
    picks = sample.where(F.col("h").isin(heads)).orderBy("lang", u, "h")
    grams = picks.select("text", "lang").mapInArrow(lambda it: _sparse(it, max_gram, buckets), "lang string, grams binary").collect()
    if not grams:
        empty = np.zeros((buckets, 0), dtype=np.float32)
        return KernelModel((), empty, np.zeros(0, np.float32), np.zeros((0, 0)), max_gram)
    landmarks = np.zeros((buckets, len(grams)), dtype=np.float32)
    for j, row in enumerate(grams):
        landmarks[np.frombuffer(row.grams, np.int32), j] = 1
    sizes = landmarks.sum(axis=0)
    shared = spark.sparkContext.broadcast((landmarks, sizes))
    rows = sample.select("text", "lang").mapInArrow(lambda it: _features(it, shared, max_gram), "lang string, kernel binary").collect()
    shared.unpersist()
    languages = tuple(sorted({r.lang for r in rows}))
    k = np.stack([np.frombuffer(r.kernel, np.float32) for r in rows]).astype(np.float64)
    place = {name: i for i, name in enumerate(languages)}
    label = np.array([place[r.lang] for r in rows])
    # Classes weigh alike, however many texts each has.
    w = np.sqrt(len(rows) / len(languages) / np.bincount(label)[label])[:, None]
    among = _kernels(landmarks.T, landmarks, sizes).astype(np.float64)
    value, vector = np.linalg.eigh((among + among.T) / 2)
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    z = (k @ root) * w
    # Targets are 1 for the language of a text and -1 for others.
    order = np.argsort(label, kind="stable")
    own = np.add.reduceat((z * w)[order], np.searchsorted(label[order], np.arange(len(languages))))
    target = (2 * own - own.sum(axis=0)).T
    solved = np.linalg.solve(z.T @ z + ridge * len(rows) * np.eye(z.shape[1]), target)
    return KernelModel(languages, landmarks, sizes, (root @ solved).astype(np.float32), max_gram)


def _predict(batches: Iterable[pa.RecordBatch], shared: object, column: str) -> Iterator[pa.RecordBatch]:
    model: KernelModel = shared.value
    for rows, data, offsets in _blocks(batches, column):
        n = rows.num_rows
        letters = rows.column("lettered").to_numpy(zero_copy_only=False)
        names, scores = [UNKNOWN] * n, np.zeros(n)
        if model.languages:
            p = _presences(data, offsets, model.max_gram, model.buckets)
            raw = _kernels(p, model.landmarks, model.sizes) @ model.weights
            best = raw.argmax(axis=1)
            # One-versus-rest values are near 1 for the language of a text and near -1 for others.
            sure = np.clip((raw[np.arange(n), best].astype(np.float64) + 1) / 2, 0, 1)
            names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters)]
            scores = np.where(letters, sure, 0.0)
        kept = [c for c in rows.schema.names if c not in ("text", "lettered")]
        yield pa.record_batch(
            [*(rows.column(c) for c in kept), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
            [*kept, "lang_pred", "score"],
        )


def predict_languages(docs: DataFrame, model: KernelModel, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns with lang_pred and score (0 to 1) of each whole text.

    A text that is null or has no letter is ``und`` with score 0, as is every text when
    nothing was learned.  Ties go to the first language by name.  Only the text is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    column = "c_text" if "text" in carry else "text"  # the text goes to the tasks once
    text = [] if "text" in carry else [F.col("text").cast("string").alias("text")]
    rows = docs.select(*(F.col(c).alias(f"c_{c}") for c in carry), *text, _has_letter("text").alias("lettered"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`c_{c}` {kinds[f'c_{c}']}" for c in carry)
    found = rows.mapInArrow(lambda it: _predict(it, shared, column), f"{schema}, lang_pred string, score double")
    return found.select(*(F.col(f"c_{c}").alias(c) for c in carry), "lang_pred", "score")
