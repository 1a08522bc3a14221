"""Bottom-k copies, spelling variants, prefix tries, anchors and the pipeline's stages on small cases."""

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chainrisk.llm import bottom_k, levels, linking, prefix_trie, spelling_variants, suffix_dedup
from chainrisk.llm.bottom_k import sketch_copies
from chainrisk.llm.jaccard_join import jaccard_classes
from chainrisk.llm.prefix_trie import prefix_trie as trie
from chainrisk.llm.spelling_variants import near_words
from chainrisk.llm.spelling_variants import spelling_variants as variants

DOC = "doc_id bigint, text string, n string, class string, part string, token string, word string, key string"
TURN = "conv_id bigint, turn bigint, role string, text string, path string, part string, kind string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 6) for r in rows], DOC)


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], TURN)


# -- bottom-k ----------------------------------------------------------------


def plain_components(rows, size, percent):
    sets = []
    for doc_id, text in rows:
        w = (text or "").lower().split()
        s = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
        sets.append((doc_id, s))
    low = [d for d, _ in sets]
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(sets):
            for j, (_, b) in enumerate(sets):
                if a and b and 100 * len(a & b) >= percent * len(a | b) and low[j] < low[i]:
                    low[i], changed = low[j], True
    return {(d, len(s), c) for (d, s), c in zip(sets, low)}


def family_rows(seed, members, length):
    """Edited copies of a few texts, and chains in which only neighbours link."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, doc_id = [], 0
    for _ in range(6):
        words = [rng.choice(vocabulary) for _ in range(length)]
        for _ in range(members):
            rows.append((doc_id, " ".join(words)))
            doc_id += 1
            base = list(words)
            for _ in range(max(1, length // 30)):
                base[rng.randrange(length)] = rng.choice(vocabulary)
            if rng.random() < 0.6:
                words = base
    return rows


@pytest.mark.parametrize("length", [5, 12, 60, 300])
def test_bottom_k_equals_all_pairs(spark, length):
    rows = family_rows(length, 12, length) + [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "One")]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in sketch_copies(docs_of(spark, rows)).collect()}
    assert got == plain_components(rows, 2, 80)


def test_bottom_k_of_odd_rows(spark):
    same = "the cat sat on the mat and looked at the dog"
    long_text = "word other " * 100_000
    rows = [(1, same), (1, same), (None, same), (2, same.upper()), (3, None), (3, None), (4, long_text), (5, long_text + "x")]
    got = [tuple(r) for r in sketch_copies(docs_of(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(
        [
            (1, 10, 1, True), (1, 10, 1, True), (None, 10, None, True), (2, 10, 1, False), (3, 0, 3, True),
            (3, 0, 3, True), (4, 2, 4, True), (5, 3, 5, True),
        ],
        key=str,
    )
    assert sketch_copies(docs_of(spark, [])).collect() == []
    with pytest.raises(ValueError):
        sketch_copies(docs_of(spark, rows), percent=60)


def test_estimate_keeps_links_at_the_least_similarity():
    rng = np.random.default_rng(7)
    k, lost = bottom_k.RETAINED, 0
    for _ in range(400):
        pool = np.sort(rng.integers(0, 1 << 62, 1000, dtype=np.uint64))
        shared, one, two = np.split(rng.permutation(pool), [800, 900])
        a, b = np.sort(np.append(shared, one))[:k], np.sort(np.append(shared, two))[:k]
        union = np.sort(np.union1d(a, b))[:k]
        common = np.intersect1d(np.intersect1d(a, b), union)
        lost += 2 * len(common) < len(union)
        assert len(np.intersect1d(a, b)) >= bottom_k.least_overlap(900, k, 80)
    assert lost == 0


@pytest.mark.parametrize("percent", [75, 80, 95])
def test_links_share_enough_windows(percent):
    rng = np.random.default_rng(percent)
    k = bottom_k.RETAINED
    for union in [*range(2, 130), 400, 1000]:
        missing = union * (100 - percent) // 100
        for _ in range(40 if missing else 0):
            pool = rng.permutation(np.sort(rng.integers(0, 1 << 62, union, dtype=np.uint64)))
            cut = rng.integers(0, missing + 1)
            one, two, shared = pool[:cut], pool[cut:missing], pool[missing:]
            a, b = np.sort(np.append(shared, one)), np.sort(np.append(shared, two))
            met = np.intersect1d(bottom_k.windows(a[:k], len(a), percent), bottom_k.windows(b[:k], len(b), percent))
            assert len(met) >= max(1, min(bottom_k.least_windows(len(x), k, percent) for x in (a, b)))


def test_common_shingles_do_not_fill_lists(spark, tmp_path):
    """Unlike texts of a small vocabulary, one line in all of them: hardly any two meet in a list."""
    rng = random.Random(11)
    line, k = " ".join(f"line{i}" for i in range(20)), bottom_k.RETAINED
    rows = [(i, f"{line} " + " ".join(f"w{rng.randrange(120)}" for _ in range(150))) for i in range(400)]
    docs_of(spark, rows).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    table = levels.corpus_levels(docs.select("text"), lambda it: bottom_k._windows(it, 2, 80, k), bottom_k.STEPS)
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t in rows])
    listed = [x for out in bottom_k._sketched([batch], table, 2, 80, k) for x in out.column("listed").flatten().to_pylist()]
    _, lengths = np.unique(listed, return_counts=True)
    assert (lengths**2).sum() < 20 * len(rows)


@pytest.mark.parametrize("percent", [75, 80, 95])
def test_links_share_enough_windows_of_listed_values(percent):
    rng = np.random.default_rng(percent)
    k = bottom_k.LISTED
    for union in [*range(130, 270, 7), 400, 1000]:
        missing = union * (100 - percent) // 100
        for _ in range(40):
            pool = rng.permutation(np.sort(rng.integers(0, 1 << 62, union, dtype=np.uint64)))
            cut = rng.integers(0, missing + 1)
            one, two, shared = pool[:cut], pool[cut:missing], pool[missing:]
            a, b = np.sort(np.append(shared, one)), np.sort(np.append(shared, two))
            met = np.intersect1d(bottom_k.windows(a[:k], len(a), percent), bottom_k.windows(b[:k], len(b), percent))
            assert len(met) >= max(bottom_k.least_windows(len(x), k, percent) for x in (a, b))


def test_a_common_passage_does_not_fill_lists(spark, tmp_path):
    """Half of every text is one passage, the rest unlike: with LISTED values hardly any two meet in a list."""
    rng = random.Random(12)
    passage = " ".join(f"passage{i}" for i in range(90))
    rows = [(i, f"{passage} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(95))) for i in range(400)]
    docs_of(spark, rows).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t in rows])
    met = {}
    for k in (bottom_k.RETAINED, bottom_k.LISTED):
        table = levels.corpus_levels(docs.select("text"), lambda it: bottom_k._windows(it, 2, 80, k), bottom_k.STEPS)
        out = [x for b in bottom_k._sketched([batch], table, 2, 80, k) for x in b.column("listed").flatten().to_pylist()]
        met[k] = int((np.unique(out, return_counts=True)[1] ** 2).sum())
    assert met[bottom_k.LISTED] < len(rows) < met[bottom_k.RETAINED]


def test_no_turns_where_whole_lists_are_short(spark):
    """One class outside the large part of a list meets the list at once, and links are still found there."""
    rows = [(1, c) for c in range(12)] + [(2, c) for c in (3, 20, 21, 22)] + [(3, 20), (3, 21)]
    entries = spark.createDataFrame(rows, "token bigint, group bigint").selectExpr("*", "group AS head", "10L AS n")
    member = entries.selectExpr("group", "group AS class").distinct()
    true = {(a, b) for a in range(11) for b in range(11)} | {(3, 22), (22, 3), (20, 21), (21, 20)}
    tried = []

    def verify(pairs):
        tried.append(pairs.count())
        found = [(r.a, r.b) for r in pairs.collect() if (r.a, r.b) in true]
        return spark.createDataFrame(found, "a bigint, b bigint")

    parts = linking.linked_parts(entries, member, verify, 80, F.lit(True)).collect()
    groups = {}
    for r in parts:
        groups.setdefault(r.part, set()).add(r["class"])
    assert sorted(map(sorted, groups.values())) == [[*range(11), 22], [11], [20, 21]]
    assert len(tried) == 2


# -- spelling ----------------------------------------------------------------


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_near_words_equal_all_pairs(spark):
    rng = random.Random(3)
    letters = "abcdefgéèüxyz"
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(120)}
    for w in list(words):
        at = rng.randrange(len(w))
        words |= {w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1 :]}
    words |= {"a" * n for n in range(5, 12)} | {"aaaabaaaa", "baaaaaaaa", "x" * 3000, "x" * 1500 + "y" + "x" * 1499}
    table = spark.createDataFrame([(w, 3) for w in sorted(words)], "word string, n bigint")
    got = {(r.word, r.near) for r in near_words(table).collect()}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_forms_and_roots(spark):
    counts = {"colour": 40, "color": 20, "colr": 9, "colors": 10, "colours": 3, "colored": 2, "mètre": 6, "metre": 3, "mitre": 3}
    text = " ".join(w for w, n in counts.items() for _ in range(n)).replace("color ", "COLOR 9", 1)
    # Ids for which no run of the text loses a letter.
    safe = [i for i in range(5000) if all(zlib.crc32(f"{i}:{w}".encode()) % 97 for w in counts)]
    got = {r.word: r for r in variants(docs_of(spark, [(safe[0], text), (safe[1], None), (safe[2], "")])).collect()}
    assert set(got) == {"colour", "color", "colors", "colours", "mètre", "metre", "mitre"}
    assert got["color"].form == "colour" and got["color"].form_n == 40 and got["color"].n_near == 2
    assert (got["colors"].form, got["colors"].root) == ("color", "colour")
    assert got["colours"].form == "colour" and got["colour"].form is None and got["colour"].root == "colour"
    assert (got["metre"].form, got["mitre"].form, got["mitre"].n_near) == ("mètre", "mètre", 2)
    assert variants(docs_of(spark, [])).collect() == []


def test_a_letter_is_lost_by_checksum(spark):
    word = "variant"
    ids = [i for i in range(2000) if zlib.crc32(f"{i}:{word}".encode()) % 97 == 0][:3]
    want = {}
    for i in ids:
        at = zlib.crc32(f"{i}:{word}".encode()) % len(word)
        cut = word[:at] + word[at + 1 :]
        want[cut] = want.get(cut, 0) + 3
    rows = [(i, "Variant VARIANT variant") for i in ids]
    got = {r.word: r.n for r in variants(docs_of(spark, rows)).collect()}
    assert got == want


def test_a_long_text_is_counted_in_parts(monkeypatch):
    monkeypatch.setattr(spelling_variants, "COUNTED", 4)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] * 3
    batch = pa.record_batch([pa.array(["0", None]), pa.array([" ".join(words), "x"])], ["doc_id", "text"])
    total = {}
    for part in spelling_variants._counts([batch]):
        assert part.num_rows <= 8
        for w, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            total[w] = total.get(w, 0) + n
    assert sum(total.values()) == len(words) + 1


# -- trie --------------------------------------------------------------------


def plain_trie(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            md5 = hashlib.md5((text or "").encode()).hexdigest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", md5, text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    nodes = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        path = own.get(conv - int(math.fmod(conv, 5)), [])[:h] + turns[h:]
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append((conv, d == len(path)))
    out = set()
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        leaves = [q for q in below if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below)]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(str(c) for c in sorted(c for c, e in members if e))
        parent = min(c for c, _ in nodes[p[:-1]]) if p else None
        children = sum(len(q) == len(p) + 1 for q in below)
        out.add((min(c for c, _ in members), len(p), parent, len(members), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def test_trie_equals_plain_trie(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "HELD_CHILDREN", 3)
    rng = random.Random(5)
    rows = []
    for conv in range(160):
        for turn in range(rng.randint(1, 6)):
            rows.append((conv, turn, rng.choice(["user", "assistant"]), rng.choice(["a", "é", "ccc"])))
    # A hot beginning, a hot whole conversation, a long one, ties, repeated rows, nulls.
    for conv in range(1000, 1200):
        rows += [(conv, 0, "user", "hello"), (conv, 1, "assistant", "hi")] + ([(conv, 2, "user", f"q{conv}")] if conv % 2 else [])
    rows += [(2000, t, "user", f"turn {t}") for t in range(300)]
    rows += [(3000, None, None, None), (3000, None, "user", "x"), (3000, 1, "user", "b"), (3000, 1, "user", "a"), (3000, 1, "user", "a")]
    rows += [(None, 1, "user", "a"), (-7, 1, "user", "a"), (-10, 2, "user", "long " * 50_000)]
    got = [tuple(r) for r in trie(turns_of(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_trie(rows)


def test_trie_of_nothing_and_of_one(spark):
    assert trie(turns_of(spark, [])).collect() == []
    conv = next(c for c in range(1, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1)
    (root,) = trie(turns_of(spark, [(conv, 0, "user", "gone")])).collect()
    assert tuple(root)[:7] == (conv, 0, None, 1, 0, 1, 0) and root.ends_sha256 == hashlib.sha256(str(conv).encode()).hexdigest()


def test_equal_paths_are_spread_over_ranges(spark):
    rows = [(c, 0, "user", "same") for c in range(0, 20_000, 5)]
    paths = prefix_trie.rebuilt_paths(turns_of(spark, rows))
    cuts = prefix_trie.splitters(paths, 8)
    assert len({c for _, c in cuts}) == len(cuts) >= 6


# -- counting and pipeline ---------------------------------------------------


def test_anchors_use_all_buckets():
    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, rng.integers(97, 123, 2000))) for _ in range(200)]
    batch = pa.record_batch([pa.array(texts)], ["text"])
    packed = levels._packed([batch], lambda it: suffix_dedup._anchors(it, 200), 8)
    assert len({b for p in packed for b in p.column("bucket").to_pylist()}) > 0.9 * 256


def test_levels_merge_counts_and_prove_uniqueness(spark):
    rows = spark.createDataFrame([(i,) for i in range(3000)] + [(7,)] * 5000, "h bigint").repartition(5)
    numbers = lambda batches: (np.array(b.column("h").to_pylist(), np.uint64) for b in batches)
    table = levels.corpus_levels(rows, numbers, (2, 64, 4096)).value
    found = levels.level_of(table, np.arange(3000, dtype=np.uint64))
    assert found[7] == 3 and (np.delete(found, 7) == 0).mean() > 0.99


def test_no_clean_document_goes_with_its_id(spark):
    near = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, near + " a"), (1, near + " b"), (2, near + " a"), (1, "quite another text with other words in it"), (3, None), (3, None)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    got = sorted((r.doc_id, r.text or "") for r in kept.collect())
    assert kept.columns == docs.columns and len(got) == 4
    assert (1, "quite another text with other words in it") in got and got.count((3, "")) == 2


def test_pieces_keep_the_global_order(spark):
    rows = [(i % 40, f"text number {i % 40} of some words", "en", f"s{i % 40 % 3}", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    mixed = corpus_pipeline.mix_stage(spark, docs, "")
    assert mixed.columns[:5] == docs.columns
    pieces = corpus_pipeline.piece_stage(spark, mixed, "")
    plan = pieces._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    place = lambda df: df.withColumn("p", F.spark_partition_id()).select("p", "mix_key").collect()
    by_part = {}
    for r in place(pieces):
        by_part.setdefault(r.p, []).append(r.mix_key)
    assert all(keys == sorted(keys) for keys in by_part.values())


def test_lists_and_pairs_carry_numbers_in_place_of_digests(spark, monkeypatch):
    kinds = []
    original = linking.stage

    def watched(df, name):
        kinds.extend(kind for _, kind in df.dtypes)
        return original(df, name)

    monkeypatch.setattr(linking, "stage", watched)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join([*words, f"end{k}"]) for k in range(6)] + [" ".join(words[::-1])] * 2
    docs = docs_of(spark, list(enumerate(texts)))
    for found in (sketch_copies(docs), jaccard_classes(docs)):
        assert {r.doc_id: r.component_id for r in found.collect()} == {**dict.fromkeys(range(6), 0), 6: 6, 7: 6}
    assert kinds and "binary" not in kinds
