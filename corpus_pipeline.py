"""A corpus pipeline of five of the operators: each stage reads what the one before it wrote.

1. language_id: documents without a recognisable language go.
2. near_duplicates: one document of each group of near copies stays.
3. repeated_strings: strings of 200 bytes that occur twice or more are cut out.
4. source_mix: sources are repeated to target weights, in a random order.
5. pieces: texts become merge pieces with seeded dropout.

All stages but the last return the columns of ``documents`` they were given; source_mix
adds the number and the key of each copy where the table has no columns of these names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainrisk.llm.jaccard_join import jaccard_classes
from chainrisk.llm.language_id import UNKNOWN, fit_languages, held_out, predict_languages
from chainrisk.llm.merge_dropout import encode_documents
from chainrisk.llm.source_mixing import poisson_mix, tempered_weights
from chainrisk.llm.suffix_dedup import cut_repeats
from chainrisk.sources.staging import release_paths, stage, staged

#: What source_mix adds: a copy's number and its place in the order.
MIXED = ("mix_copy", "mix_key")


def _numbered(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but the text under names that no operator uses."""
    return docs.select("text", *(F.col(c).alias(f"p_{i}") for i, c in enumerate(docs.columns) if c != "text"))


def _column(rows: DataFrame, docs: DataFrame, name: str) -> Column:
    return rows[f"p_{docs.columns.index(name)}"]


def _named(rows: DataFrame, docs: DataFrame, changed: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Back to the columns of ``docs``, some of them changed."""
    out = []
    for i, name in enumerate(docs.columns):
        column = rows["text"] if name == "text" else rows[f"p_{i}"]
        if name in changed:
            column = changed[name](column).cast(docs.schema[name].dataType)
        out.append(column.alias(name))
    return rows.select(*out)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; those without a letter, or null, go.

    ``lang`` becomes the predicted language.  The model learns from the documents outside
    the held-out fifth that have a language and a letter; if none has, nothing is rejected
    but texts without a letter.
    """
    model = fit_languages(docs.where(~held_out(5)))
    rows = _numbered(docs)
    found = predict_languages(rows, model, carry=tuple(rows.columns))
    known = F.lit(bool(model.languages))
    kept = found.where((F.col("lang_pred") != UNKNOWN) | (~known & F.col("text").rlike(r"\p{L}")))
    language = F.when(F.col("lang_pred") != UNKNOWN, F.col("lang_pred"))
    return _named(kept, docs, {"lang": lambda lang: F.coalesce(language, lang)})


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies: the one with the smallest (doc_id, text hash).

    Components are told apart by their texts, so unlinked texts stay even where their
    doc_id is the same.  Rows without doc_id, and texts that link with nothing, stay.
    """
    rows = jaccard_classes(docs).where("doc_id is not null and part is not null")
    rows = rows.groupBy("part", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("j_rows"))
    heads = rows.groupBy("part").agg(F.min(F.struct("doc_id", "text_hash")).alias("m"))
    heads = heads.select("m.doc_id", "m.text_hash", F.lit(True).alias("j_head"))
    # A head that stands in one row needs no look-up, so the keys are those of copies only.
    keys = rows.drop("part").join(heads, ["doc_id", "text_hash"], "left").where("j_head is null or j_rows > 1")
    keys = stage(keys.select(F.col("doc_id").alias("j_id"), F.col("text_hash").alias("j_hash"), "j_rows", "j_head"), "copies")
    plain = docs.select(*(F.col(c).alias(f"p_{i}") for i, c in enumerate(docs.columns)))
    doc_id, text = (plain[f"p_{docs.columns.index(c)}"] for c in ("doc_id", "text"))
    same = (doc_id.cast("bigint") == F.col("j_id")) & (F.xxhash64(text.cast("string")) == F.col("j_hash"))
    kept = plain.join(keys, same, "left").where("j_rows is null or j_head")
    single = kept.where("j_rows is null")
    several = kept.where("j_head").dropDuplicates(["j_id", "j_hash"])
    both = single.unionByName(several)
    return both.select(*(F.col(f"p_{i}").alias(c) for i, c in enumerate(docs.columns)))


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated strings; characters cut at an edge of a string go with it.

    ``n_chars`` is counted anew, a text of which nothing is left stays as an empty one, and
    a null text stays null.
    """
    rows = _numbered(docs).withColumn("p_null", F.col("text").isNull())
    carry = tuple(c for c in rows.columns if c != "text")
    cut = cut_repeats(rows.withColumn("doc_id", _column(rows, docs, "doc_id")), carry=carry, as_text=True)
    cut = cut.withColumn("text", F.when(~F.col("p_null"), F.col("kept")))
    count = F.when(F.col("n_removed") > 0, F.length("text"))
    return _named(cut, docs, {"n_chars": lambda n: F.coalesce(count, n)})


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated towards weights by the square root of their size, in a random order.

    ``mix_copy`` and ``mix_key`` (a copy's number and its place in the order) travel on
    behind the columns of ``docs``.  A table that brings a column of either name keeps its
    own columns and gets neither.
    """
    if not set(MIXED) & set(docs.columns):
        return poisson_mix(docs, tempered_weights(docs))
    keys = ("doc_id", "source")
    rows = docs.select(*keys, *(F.col(c).alias(f"p_{i}") for i, c in enumerate(docs.columns) if c not in keys))
    mixed = poisson_mix(rows, tempered_weights(rows))
    return mixed.select(*(F.col(c if c in keys else f"p_{i}").alias(c) for i, c in enumerate(docs.columns)))


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source with the pieces of each text; copies of a document are drawn apart.

    Copies are told apart by ``mix_copy``, which is kept with ``mix_key``, as is the order
    of ``docs``.  Rows without these two are numbered here, which shuffles them.
    """
    if set(MIXED) <= set(docs.columns):
        return encode_documents(docs, carry=("doc_id", "lang", "source", *MIXED), copy="mix_copy")
    alike = Window.partitionBy("doc_id", "lang", "source", F.xxhash64("text")).orderBy(F.lit(0))
    copies = docs.select("doc_id", "lang", "source", "text", F.row_number().over(alike).alias("copy"))
    return encode_documents(copies, carry=("doc_id", "lang", "source"), copy="copy")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_strings", repeat_stage),
    ("source_mix", mix_stage),
    ("pieces", piece_stage),
]

#: SQL cannot express the first, third and fifth stage on whole tables.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each result is written and read again.

    What a stage staged goes, with the stage's input, as soon as its result is written.
    """
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    spent = staged(spark)
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
        *old, _ = [path for path in staged(spark) if path not in spent]
        release_paths(spark, old)
    return STAGES[-1][1](spark, docs, sf_dir)
