"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing column names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chainrisk.llm.byte_ppm import ppm_scores
from chainrisk.llm.hash_tree import tree_shards
from chainrisk.llm.host_rules import host_verdicts
from chainrisk.llm.jaccard_join import jaccard_classes
from chainrisk.llm.language_id import fit_languages, held_out, predict_languages
from chainrisk.llm.maxscore_search import maxscore_topk, whole_components
from chainrisk.llm.merge_dropout import decode_documents, encode_documents
from chainrisk.llm.neighbour_quality import fit_votes, vote_scores
from chainrisk.llm.source_mixing import poisson_mix, tempered_weights
from chainrisk.llm.suffix_dedup import cut_repeats

LONG = "word " * 60_000 + "é" * 3000
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHES = ("rid", "tag", "body", "n", "class", "group", "spans", "kept", "score", "c_doc_id", "h", "v", "mix_copy", "words")
ROWS = [
    (1, "The cat sat on the mat and looked at the dog.", "en", "a", 3),
    (1, "The cat sat on the mat and looked at the dog.", "en", "a", 3),
    (2, None, "en", None, None),
    (3, "", None, "b", 0),
    (4, LONG, "en", "a", len(LONG)),
    (5, " \n\t ", "fr", "b", 4),
    (6, "123 456 !!!", "fr", "b", 4),
    (None, "Le chat est sur la table et le chien est dehors.", "fr", "c", 9),
    (7, "Le chat est sur la table et le chien est dehors.", "fr", "c", 9),
    (8, "▁ x  y\u0000z 😀\r\n", None, "c", 9),
]


@pytest.fixture(params=["rows", "empty"])
def docs(request, spark):
    df = spark.createDataFrame(ROWS if request.param == "rows" else [], SCHEMA)
    for name in CLASHES:
        df = df.withColumn(name, F.lit("x"))
    return df


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=lambda x: (x is None, x))


def test_every_document_gets_one_row(spark, docs):
    want = ids(docs)
    folds = docs.withColumn("held_out", held_out(5))
    labels = folds.select("doc_id", F.lit(1).alias("label"))
    results = [
        vote_scores(docs, fit_votes(docs, labels)),
        host_verdicts(docs),
        jaccard_classes(docs),
        tree_shards(docs),
        encode_documents(docs),
        cut_repeats(docs),
        ppm_scores(folds, folds),
        predict_languages(docs, fit_languages(docs)),
    ]
    for df in results:
        assert ids(df) == want, df.columns


def test_defined_results_of_odd_texts(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    by_id = lambda df: {r.doc_id: r for r in df.collect()}
    joined = by_id(jaccard_classes(docs))
    assert joined[1].component_id == 1 and joined[2].n_shingles == 0 and joined[5].component_id == 5
    assert joined[6].n_shingles == 1 and joined[None].component_id is None
    cut = by_id(cut_repeats(docs))
    assert cut[2].n_bytes == 0 and cut[4].n_removed > 200_000 and cut[1].n_removed == 0
    rules = by_id(host_verdicts(docs))
    assert rules[4].n_repeat_words == 60_000 and rules[2].n_words == 0 and rules[2].base_failed
    language = by_id(predict_languages(docs, fit_languages(docs)))
    assert [language[k].lang_pred for k in (2, 3, 5, 6)] == ["und"] * 4
    pieces = by_id(encode_documents(docs))
    assert all(r.lossless for r in pieces.values()) and pieces[2].ids == []
    texts = by_id(decode_documents(encode_documents(docs)))
    assert texts[8].text == ROWS[-1][1] and texts[4].text == LONG
    scores = by_id(ppm_scores(docs.withColumn("held_out", F.lit(False)), docs))
    assert scores[2].n_tokens == 1 and scores[2].score < 0
    shards = tree_shards(docs).collect()
    for s in {r.shard for r in shards}:
        assert sorted(r.slot for r in shards if r.shard == s) == list(range(sum(r.shard == s for r in shards)))


def test_every_language_is_learned(spark):
    words = lambda k: " ".join(f"{chr(0x4E00 + 40 * k + i % 40)}{chr(0x4E00 + 40 * k + i * i % 40)}" for i in range(60))
    rows = [(words(k) + f" {j}", f"l{k:02}") for k in range(70) for j in range(1 if k == 69 else 3)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, text string, lang string")
    model = fit_languages(docs)
    assert len(model.languages) == 70
    found = {r.doc_id: r.lang_pred for r in predict_languages(docs, model).collect()}
    assert all(found[i] == lang for i, (_, lang) in enumerate(rows))


def test_copies_do_not_crowd_out_a_language(spark):
    same = spark.range(2000).selectExpr("id AS doc_id", "'the same text again' AS text", "'en' AS lang")
    other = [(5000 + i, f"un autre texte {i}", "fr") for i in range(4)]
    few = [(6000 + i, f"some other text {i}", "en") for i in range(4)]
    docs = same.unionByName(spark.createDataFrame(other + few, "doc_id bigint, text string, lang string"))
    model = fit_languages(docs, per_language=5)
    assert model.languages == ("en", "fr") and model.landmarks.shape[1] == 9


def test_mixing_keeps_all_columns(spark, docs):
    mixed = poisson_mix(docs, tempered_weights(docs), total=40)
    assert set(mixed.columns) == set(docs.columns) | {"mix_copy", "mix_key"}
    known = {r.text for r in docs.collect()}
    assert {r.text for r in mixed.collect()} <= known


def test_search_without_usable_vectors(spark):
    schema = "vec_id bigint, embedding array<float>"
    rows = [(0, [1.0, 0.5]), (1, [1.0, float("nan")]), (2, None), (3, [None, 1.0]), (None, [1.0, 1.0]), (50, [0.5]), (51, [1.0, 0.5])]
    for data in (rows, []):
        v = spark.createDataFrame(data, schema).select("vec_id", whole_components("embedding", 256).alias("v"))
        got = [tuple(r) for r in maxscore_topk(v.where("vec_id % 50 = 0"), v, 5).orderBy("query_id", "rank").collect()]
        want = [(0, 1, 51, 256**2 + 128**2), (0, 2, 50, 128 * 256), (50, 1, 0, 128 * 256), (50, 2, 51, 128 * 256)]
        assert got == (want if data else [])


def test_pipeline_stages_keep_the_columns(spark, docs, tmp_path):
    path = str(tmp_path / "documents.parquet")
    docs.write.parquet(path)
    frame = spark.read.parquet(path)
    for name, apply in corpus_pipeline.STAGES:
        out = apply(spark, frame, str(tmp_path))
        if name != "pieces":
            assert out.columns == docs.columns
            frame = spark.createDataFrame(out.collect(), out.schema)
        else:
            assert all(r.lossless for r in out.collect())


def test_mix_stage_keeps_a_column_named_like_its_own(spark, tmp_path):
    """A table's own mix_copy or mix_key stays as it is; copies are still drawn apart, and alike without the clash."""
    rows = [(i, "some words of a text to cut into pieces", "en", "ab"[i % 5 == 0], 3) for i in range(40)]
    plain = spark.createDataFrame(rows, SCHEMA)
    mixed = corpus_pipeline.mix_stage(spark, plain, str(tmp_path))
    assert mixed.columns == [*plain.columns, *corpus_pipeline.MIXED]
    want = ids(mixed)
    for name in corpus_pipeline.MIXED:
        own = plain.withColumn(name, F.concat(F.lit("own"), "doc_id"))
        out = corpus_pipeline.mix_stage(spark, own, str(tmp_path))
        assert out.columns == own.columns and ids(out) == want
        assert all(r[name] == f"own{r.doc_id}" for r in out.collect())
        pieces = corpus_pipeline.piece_stage(spark, out, str(tmp_path))
        assert ids(pieces) == want
        assert len({(r.doc_id, tuple(r.ids)) for r in pieces.collect()}) > len(set(want))
