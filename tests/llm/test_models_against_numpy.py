"""Votes and kernel ridge regression of all texts against plain numpy, one text at a time."""

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chainrisk.llm.language_id import _presences, fit_languages, predict_languages
from chainrisk.llm.neighbour_quality import fit_votes, term_counts, vote_scores

FOLDER = "/root/testdata/sf0.001"


def rows_of(columns, table):
    return duckdb.sql(f"SELECT {columns} FROM '{FOLDER}/{table}.parquet'").fetchall()


def learns(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 != 0


def data_of(text):
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return raw, np.array([0, len(raw)])


def unit(v):
    return v / max(np.linalg.norm(v), 1e-12)


def test_votes_equal_plain_votes(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    labels = [(i, q) for i, q in rows_of("doc_id, quality", "labels") if i is not None and q is not None and learns(i)]
    model = fit_votes(docs, spark.createDataFrame(labels, "doc_id long, label int"))
    texts = dict(rows_of("doc_id, text", "documents"))
    # The sample holds every labelled text here, so labels weigh one each.
    assert len(model.labels) == len(labels) and np.allclose(model.weights, 1)
    assert model.prior == pytest.approx(np.mean([q for _, q in labels]))

    counts = np.array([term_counts(*data_of(texts[i]))[0] for i, _ in labels], float)
    idf = np.log((1 + len(labels)) / (1 + (counts > 0).sum(axis=0))) + 1
    weighted = np.array([unit(np.log1p(c) * idf) for c in counts])
    rank = model.basis.shape[1]
    right = np.linalg.svd(weighted, full_matrices=False)[2][:rank]
    # The space holds nearly as much of the sample as the best one of its rank.
    best = np.linalg.norm(weighted @ right.T) ** 2
    assert np.linalg.norm(weighted @ model.basis) ** 2 >= 0.97 * best

    space = model.basis.astype(float)
    vectors = np.array([unit(x @ space) for x in weighted])
    label = np.array([q for _, q in labels], float)
    got = {r.doc_id: r.score for r in vote_scores(docs, model).collect()}
    assert got.keys() == texts.keys()
    compared = 0
    for i, text in texts.items():
        cosine = vectors @ unit(unit(np.log1p(term_counts(*data_of(text))[0]) * idf) @ space)
        order = np.argsort(-cosine)
        if cosine[order[14]] - cosine[order[15]] < 1e-5:
            continue  # either of two equal neighbours may vote
        votes = np.maximum(cosine[order[:15]], 0) ** 8
        want = (1e-6 * model.prior + votes @ label[order[:15]]) / (1e-6 + votes.sum())
        assert got[i] == pytest.approx(want, abs=1e-3)
        compared += 1
    assert compared >= 0.8 * len(texts)


def test_kernel_ridge_equals_plain_least_squares(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    ridge = 1e-3
    model = fit_languages(docs, ridge=ridge)
    pairs = sorted({(t, g) for t, g in rows_of("text, lang", "documents") if g is not None and any(c.isalpha() for c in t or "")})
    assert model.languages == tuple(sorted({g for _, g in pairs}))

    grams = lambda text: set(np.flatnonzero(_presences(*data_of(text), model.max_gram, model.buckets)[0]).tolist())
    heads = [set(np.flatnonzero(c).tolist()) for c in model.landmarks.T]
    texts = {t for t, _ in pairs}
    assert all(h in [grams(t) for t in texts] for h in heads[:5])

    def kernel(own):
        return np.array([len(own & h) / np.sqrt(max(len(own), 1) * max(len(h), 1)) for h in heads])

    among = np.array([kernel(h) for h in heads])
    value, vector = np.linalg.eigh((among + among.T) / 2)
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    z = np.array([kernel(grams(t)) for t, _ in pairs]) @ root
    of = np.array([model.languages.index(g) for _, g in pairs])
    target = np.where(of[:, None] == np.arange(len(model.languages)), 1.0, -1.0)
    w = np.sqrt(len(pairs) / len(model.languages) / np.bincount(of)[of])[:, None]
    shrink = np.sqrt(ridge * len(pairs)) * np.eye(z.shape[1])
    rest = np.zeros((z.shape[1], target.shape[1]))
    beta = np.linalg.lstsq(np.vstack([z * w, shrink]), np.vstack([target * w, rest]), rcond=None)[0]

    got = {r.doc_id: r for r in predict_languages(docs.select("doc_id", "text"), model).collect()}
    for i, text in rows_of("doc_id, text", "documents"):
        if not any(c.isalpha() for c in text or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        values = kernel(grams(text)) @ root @ beta
        assert got[i].score == pytest.approx(np.clip((values.max() + 1) / 2, 0, 1), abs=2e-3)
        first, second = np.sort(values)[::-1][:2]
        if first - second > 1e-2:
            assert got[i].lang_pred == model.languages[values.argmax()]


def test_neighbours_of_empty_and_tied_texts(spark):
    docs = spark.createDataFrame(
        [(1, "good words here"), (2, "good words here"), (3, "poor 1234 5678"), (4, None), (5, ""), (6, "good words here")],
        "doc_id long, text string",
    )
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (3, 1), (None, 1), (6, None)], "doc_id long, label int")
    model = fit_votes(docs, labels)
    assert sorted(model.labels.tolist()) == [0, 0, 1]
    got = {r.doc_id: r.score for r in vote_scores(docs, model).collect()}
    # Equal texts with either label vote one each; a text without terms gets the share of label 1.
    assert got[1] == got[2] == got[6] == pytest.approx(0.5, abs=1e-3)
    assert got[4] == got[5] == pytest.approx(1 / 3)
    nothing = fit_votes(docs, labels.where(F.lit(False)))
    assert {r.score for r in vote_scores(docs, nothing).collect()} == {0.5}
