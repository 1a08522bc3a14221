"""The operators against plain versions, SQL, or held-out labels."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from chainrisk.llm import arrays, jaccard_join, merge_dropout, suffix_dedup
from chainrisk.llm.byte_ppm import build_trie, ppm_scores, text_logs
from chainrisk.llm.hash_tree import layout, with_shard
from chainrisk.llm.maxscore_search import top_of_shard
from chainrisk.llm.queries import ORACLE, QUERIES
from tools.compare import canonical, same

FOLDER = "/root/testdata/sf0.001"
TABLE = f"'{FOLDER}/documents.parquet'"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM {TABLE}").fetchall())


def words(text):
    lowered = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def held(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds == 0


def result(spark, name):
    return {r.doc_id: r for r in QUERIES[name](spark, FOLDER).collect()}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = canonical([tuple(r) for r in df.select(*columns).collect()])
    want = canonical(con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall())
    assert len(got) == len(want) > 0
    for g, w in zip(got, want):
        assert all(same(x, y) for x, y in zip(g, w)), (columns, g, w)


def components_of(sets):
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def test_jaccard_join_equals_all_pairs(spark, texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    want = components_of(sets)
    got = result(spark, "op5_jaccard_join")
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), want[i]) for i in sets}


def test_jaccard_join_on_families_of_near_copies(spark):
    """Families around a base, chained copies, and a passage that unrelated texts share."""
    rng = np.random.default_rng(7)
    draw = lambda n: [f"w{k}" for k in rng.integers(0, 5000, n)]
    docs, base, passage = [], draw(120), draw(60)
    for _ in range(60):
        copy = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 6)):
            copy[at] = f"e{rng.integers(0, 10**6)}"
        docs.append(copy)
    chain = draw(100)
    for _ in range(12):
        docs.append(list(chain))
        chain = chain[5:] + draw(5)
    docs += [passage + draw(rng.integers(5, 60)) for _ in range(40)] + [base] * 5
    texts = {i: " ".join(d) for i, d in enumerate(docs)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_classes(df).collect()}
    assert got == components_of({i: shingles(t) for i, t in texts.items()})


def plain_cut(texts, length=200):
    raw = {i: (t or "").encode() for i, t in texts.items()}
    seen = Counter(b[k : k + length] for b in raw.values() for k in range(len(b) - length + 1))
    out = {}
    for i, b in raw.items():
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_equals_plain_search(spark, texts):
    got = result(spark, "op8_suffix_dedup")
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == plain_cut(texts)


@pytest.mark.parametrize("steps", [(2, 3, 4), (2, 2, 2)])
def test_suffix_dedup_with_very_frequent_anchors(spark, monkeypatch, steps):
    monkeypatch.setattr(suffix_dedup, "STEPS", steps)
    rng = np.random.default_rng(3)
    draw = lambda n: " ".join(rng.choice(["alpha", "be", "ga", "é", "ö", "zeta", "io"], n))
    passage = draw(90)
    items = [draw(rng.integers(0, 120)) for _ in range(15)] + [draw(20) + passage[k:] + draw(20) for k in (0, 7, 60)]
    items += ["a" * 900, "ab" * 300 + "c", "y" * 199, "z" * 200, passage, passage, items[3], ""]
    texts = dict(enumerate(items))
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = suffix_dedup.cut_repeats(df).withColumn("sha", F.sha2("kept", 256)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in got} == plain_cut(texts)


def test_run_length_index_matching_statistics():
    rng = np.random.default_rng(1)
    strings = [bytes(rng.choice(list(b"ab"), rng.integers(1, 60)).tolist()) for _ in range(30)]
    strings = sorted(set(strings))
    data = np.frombuffer(b"".join(strings), np.uint8)
    offsets = np.cumsum([0, *map(len, strings)])
    index = suffix_dedup.RunLengthIndex(data, offsets)
    assert index.lengths.sum() == len(data) and len(index.symbols) == len(index.head_at)
    got = index.matching_statistics()
    suffixes = [s[k:] for s in strings for k in range(len(s))]
    common = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    want = [max(common(s, t) for j, t in enumerate(suffixes) if j != i) for i, s in enumerate(suffixes)]
    assert got.tolist() == want


def test_merge_encoding_equals_the_library_without_dropout_and_the_agenda_with_it(texts):
    m = merge_dropout.load_merges(merge_dropout.MODEL_PATH)
    library = sentencepiece.SentencePieceProcessor(model_file=merge_dropout.MODEL_PATH)
    items = [*list(texts.values())[:80], "", " a  b\n\tc ", "é\u0000😀 x", "ab" * 300]
    data, offsets = arrays.text_arrays(pa.array(items))
    none = np.zeros(len(items), np.int64)
    pieces, at = merge_dropout.encode_texts(m, data, offsets, none, 1, 0)
    assert [pieces[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [library.encode(t) for t in items]
    limit = 1 << 30
    all_at_once = merge_dropout.encode_texts(m, data, offsets, none, 1, limit)[0]
    long, merge_dropout.LONG = merge_dropout.LONG, 0
    try:
        by_agenda = merge_dropout.encode_texts(m, data, offsets, none, 1, limit)[0]
    finally:
        merge_dropout.LONG = long
    assert (all_at_once == by_agenda).all() and len(all_at_once) > len(pieces)
    assert (merge_dropout.encode_texts(m, data, offsets, none, 2, limit)[0][:50] != all_at_once[:50]).any()


def test_settled_spans_are_spread_over_buckets():
    n = 500
    box = suffix_dedup._Outbox(8, 200)
    same, rid = np.full(n, 1 << 60, np.uint64), np.arange(n)
    box.windows.append((same, same, rid, rid * 7, np.zeros(n, np.int64)))
    got = next(box.flush_windows()).to_pandas()
    spans = got[got["kind"] == suffix_dedup._SPAN_KIND]
    assert spans["bucket"].nunique() > 100 and spans["rid"].map(len).max() < 8 * 20
    found = suffix_dedup._bucket_spans(spans, 200)
    assert sorted(found["rid"]) == rid.tolist() and set(found["size"]) == {200} and (found["tag"] == found["rid"] * 7).all()


def test_dropout_draws_every_occurrence_and_copy_by_itself(spark):
    m = merge_dropout.load_merges(merge_dropout.MODEL_PATH)
    data, offsets = arrays.text_arrays(pa.array([" ".join(["consideration"] * 400)]))
    ids = merge_dropout.encode_texts(m, data, offsets, np.zeros(1, np.int64), 1, int(0.1 * (1 << 32)))[0]
    raw = [m.bytes[m.starts[i] : m.starts[i + 1]].tobytes() for i in ids.tolist()]
    cuts = {tuple(w.split(b"|")) for w in b"|".join(raw).split(b"| ")}
    assert len(cuts) > 8
    rows = [(1, "The consideration of the documents was repeated. " * 20, "en", "a")] * 6 + [(2, "", "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    pieces = corpus_pipeline.piece_stage(spark, docs, "").where("doc_id = 1").collect()
    assert len({tuple(r.ids) for r in pieces}) == 6 and all(r.lossless for r in pieces)


def test_merge_encoding_decodes_to_the_text(spark, texts):
    encoded = QUERIES["op7_merge_dropout"](spark, FOLDER)
    assert {r.doc_id: r.text for r in merge_dropout.decode_documents(encoded).collect()} == texts
    assert encoded.where("not lossless").count() == 0


def test_unigram_base_equals_plain_counts(spark, texts):
    counts = Counter()
    for i, t in texts.items():
        if not held(i, 10):
            counts.update([*words(t), "\n"])
    total, kinds = sum(counts.values()), len(counts)
    for i, r in result(spark, "op9_byte_ppm").items():
        tokens = [*words(texts[i]), "\n"]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in tokens)
        assert r.held_out == held(i, 10) and r.train_tokens == total
        assert (r.n_tokens, r.n_known) == (len(tokens), sum(counts[w] > 0 for w in tokens))
        assert math.isclose(r.base_score, base, rel_tol=1e-9)


def test_ppm_keeps_the_contexts_that_are_not_broadcast(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("held_out", F.col("doc_id") % 10 == 0)
    docs = docs.unionByName(docs.limit(1).select(*(F.lit("日本 ÿ text").alias(c) if c == "text" else F.lit(-1).cast("bigint").alias(c) if c == "doc_id" else F.lit(True).alias(c) if c == "held_out" else F.col(c) for c in docs.columns)))
    whole = {r.doc_id: r.score for r in ppm_scores(docs, docs.where("not held_out"), contexts=1 << 24).collect()}
    for contexts in (0, 50):
        part = ppm_scores(docs, docs.where("not held_out"), contexts=contexts).collect()
        assert len(part) == len(whole)
        assert all(math.isclose(r.score, whole[r.doc_id], rel_tol=1e-9) for r in part)


def test_ppm_probabilities_sum_to_one_and_follow_a_plain_trie():
    training = [b"abracadabra", b"abra", b"cadabra!", b""]
    grams = Counter()
    for t in training:
        s = b"\xff\xff\xff" + t + b"\xff"
        grams.update(s[k : k + 4] for k in range(len(s) - 3))
    codes = np.array([int.from_bytes(g, "big") for g in grams])
    counts = np.array(list(grams.values()))
    low = Counter()
    for g, n in grams.items():
        low[g[1:]] += n
    model = build_trie(codes, counts, np.array([int.from_bytes(g, "big") for g in low]), np.array(list(low.values())))

    def plain(context, symbol):
        escape, known = 1.0, set()
        for k in (3, 2, 1, 0):
            seen = Counter()
            for g, n in grams.items():
                if g[3 - k : 3] == context[3 - k :] and g[3] not in known:
                    seen[g[3]] += n
            total = sum(seen.values()) + len(seen)
            if symbol in seen:
                return escape * seen[symbol] / total
            if seen:
                escape *= len(seen) / total
            known |= set(seen)
        return escape / (256 - len(known))

    for text in (b"abra", b"", b"cab!", b"xyz", b"abracadabra"):
        s = b"\xff\xff\xff" + text + b"\xff"
        want = sum(math.log10(plain(s[k - 3 : k], s[k])) for k in range(3, len(s)))
        got = text_logs(model, np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
        assert math.isclose(got, want, rel_tol=1e-5)
    known = len(model.symbols[model.symbols < model.logs.shape[1] - 1])
    p = 10.0 ** model.logs.astype(float)
    sums = p[:, :-1].sum(axis=1) + p[:, -1] * (256 - known)
    assert np.allclose(sums, 1, atol=1e-5)


def test_language_and_quality_on_held_out_rows(spark):
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM {TABLE}").fetchall())
    got = [r for r in result(spark, "op10_language_id").values() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.9 * len(got) > 0
    quality = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{FOLDER}/labels.parquet'").fetchall())
    scored = [(r.score, quality[i]) for i, r in result(spark, "op1_neighbour_quality").items() if r.held_out and i in quality]
    good, poor = [s for s, q in scored if q == 1], [s for s, q in scored if q == 0]
    assert sum(g > p for g in good for p in poor) >= 0.9 * len(good) * len(poor)


def test_maxscore_equals_a_full_scan():
    rng = np.random.default_rng(5)
    vectors = rng.integers(-40, 40, (3000, 24))
    vectors[rng.random(vectors.shape) < 0.5] = 0
    vectors[1500:1520] = vectors[7]
    ids = rng.permutation(9000)[:3000]
    queries, query_ids = vectors[:40], ids[:40]
    found = top_of_shard(queries, query_ids, vectors, ids, 5)
    for row in range(40):
        score = vectors @ queries[row]
        order = [(-score[k], ids[k]) for k in range(3000) if ids[k] != query_ids[row]]
        assert [(-s, i) for r, i, s in found if r == row] == sorted(order)[:5]


def test_growth_moves_rows_only_into_the_new_region(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("key"))
    grown = with_shard(with_shard(df, layout([1] * 16), "key", "a"), layout([1] * 16 + [2]), "key", "b").collect()
    assert all(r.a == r.b or r.b == 16 for r in grown)
    share = sum(r.b == 16 for r in grown) / len(grown)
    assert abs(share - 2 / 18) < 0.02 and max(Counter(r.a for r in grown).values()) < 330
