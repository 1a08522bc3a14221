"""Language-model scores: prediction by partial matching over bytes, and a word unigram base.

Training counts every four-byte string and every word of all training texts.  The
context trie holds contexts of up to three bytes.  A byte is predicted in its longest
context of the trie; escapes follow method C, and symbols of a longer context are
excluded in the shorter ones.  The frequent part of the pretrained trie is turned into
one table of log probabilities, so that scoring is a gather per byte; bytes in all other
contexts are joined with log probabilities made from the same counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainrisk.llm.arrays import SpanHash, longs, lower, segment_sums, text_chunks, word_spans
from chainrisk.sources.staging import stage

EDGE = 0xFF  # never a byte of UTF-8: stands before a text and ends it
FLUSH = 1 << 20
_GRAMS, _WORDS = 0, 1


def _stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with three edges before each and one after the last; where each text starts in it."""
    n = len(offsets) - 1
    out = np.full(len(data) + 3 * n + 1, EDGE, dtype=np.uint8)
    out[np.arange(len(data)) + 3 * (np.repeat(np.arange(n), np.diff(offsets)) + 1)] = data
    return out, offsets[:-1] + 3 * (np.arange(n) + 1)


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, n): four-byte strings that end in a byte or an end of a text, and word hashes."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {_GRAMS: [], _WORDS: []}

    def merged(kind: int) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate(x) for x in zip(*held[kind]))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(n, first)

    def flush(kind: int) -> Iterator[pa.RecordBatch]:
        keys, n = held[kind][0]
        for at in range(0, len(keys), 1 << 16):
            k = keys[at : at + (1 << 16)]
            yield pa.record_batch(
                [pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(n[at : at + (1 << 16)])],
                ["kind", "key", "n"],
            )
        held[kind].clear()

    for _, data, offsets in text_chunks(batches):
        s, starts = _stream(data, offsets)
        wide = s.astype(np.uint32)
        codes = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]
        keep = np.ones(len(s), dtype=bool)  # edges before a text are not predicted
        ends = starts + np.diff(offsets)
        keep[0] = keep[1] = keep[2] = False
        keep[np.minimum(ends[:-1] + 1, len(s) - 1)] = keep[np.minimum(ends[:-1] + 2, len(s) - 1)] = False
        small = lower(data)
        first, last, _ = word_spans(small, offsets)
        for kind, keys in ((_GRAMS, codes[keep[3:]].astype(np.uint64)), (_WORDS, SpanHash(small)(first, last))):
            if not len(keys):
                continue
            keys, n = np.unique(keys, return_counts=True)
            held[kind].append((keys, n.astype(np.int64)))
            if sum(len(k) for k, _ in held[kind]) > FLUSH:
                held[kind] = [merged(kind)]
                if len(held[kind][0][0]) > FLUSH // 2:
                    yield from flush(kind)
    for kind in held:
        if held[kind]:
            held[kind] = [merged(kind)]
            yield from flush(kind)


@dataclass(frozen=True)
class TrieModel:
    """Log10 probabilities by context row and symbol; the row of each three-symbol context."""

    symbols: np.ndarray  # byte -> symbol, unseen bytes share the last one
    rows: np.ndarray  # contexts of three symbols -> row of their longest known suffix
    logs: np.ndarray  # rows x symbols
    deep: int  # first row of a context of three symbols
    pairs: np.ndarray  # contexts of two symbols x symbols: counts


def _parts(symbols: np.ndarray, code: np.ndarray, n: int) -> list[np.ndarray]:
    return [symbols[code >> (8 * (n - 1 - i)) & 0xFF] for i in range(n)]


def _logs_of(stack: list[np.ndarray]) -> np.ndarray:
    """Log probabilities for contexts given their counts at falling orders."""
    m, size = stack[0].shape
    p = np.zeros((m, size + 1))
    escape, known = np.ones(m), np.zeros((m, size), dtype=bool)
    for level in stack:
        left = np.where(known, 0.0, level)
        total, kinds = left.sum(axis=1), (left > 0).sum(axis=1)
        some = kinds > 0
        share = np.where(some, escape / np.maximum(total + kinds, 1), 0.0)
        p[:, :size] += left * share[:, None]
        escape = np.where(some, share * kinds, escape)
        known |= left > 0
    flat = escape / np.maximum(256 - known.sum(axis=1), 1)
    p[:, :size] = np.where(known, p[:, :size], flat[:, None])
    p[:, size] = flat
    return np.log10(np.maximum(p, 1e-300)).astype(np.float32)


def build_trie(codes: np.ndarray, counts: np.ndarray, lower_codes: np.ndarray, lower_counts: np.ndarray) -> TrieModel:
    """Trie from four-byte counts of chosen contexts and the three-byte counts of all."""
    seen = np.unique(np.concatenate([lower_codes & 0xFF, [EDGE]])).astype(np.int64)
    size = len(seen)
    symbols = np.full(256, size, dtype=np.int64)
    symbols[seen] = np.arange(size)
    wide = size + 1

    a, b, c = _parts(symbols, lower_codes, 3)
    pairs = np.zeros((wide * wide, size))
    np.add.at(pairs, (a * wide + b, c), lower_counts)
    singles = pairs.reshape(wide, wide, size).sum(axis=0)
    nothing = singles.sum(axis=0, keepdims=True)

    tables = [_logs_of([nothing])]
    rows = np.zeros((wide, wide, wide), dtype=np.int32)
    known1 = np.flatnonzero(singles.sum(axis=1))
    tables.append(_logs_of([singles[known1], np.repeat(nothing, len(known1), 0)]))
    rows[:, :, known1] = 1 + np.arange(len(known1))
    known2 = np.flatnonzero(pairs.sum(axis=1))
    of1 = known2 % wide
    used = 1 + len(known1)
    tables.append(_logs_of([pairs[known2], singles[of1], np.repeat(nothing, len(known2), 0)]))
    rows.reshape(wide, wide * wide)[:, known2] = used + np.arange(len(known2))
    used += len(known2)
    deep = used
    if len(codes):
        a, b, c, d = _parts(symbols, codes, 4)
        context, place = np.unique((a * wide + b) * wide + c, return_inverse=True)
        for at in range(0, len(context), 2048):
            part = context[at : at + 2048]
            inside = (place >= at) & (place < at + len(part))
            triples = np.zeros((len(part), size))
            np.add.at(triples, (place[inside] - at, d[inside]), counts[inside])
            of2, of1 = part % (wide * wide), part % wide
            tables.append(_logs_of([triples, pairs[of2], singles[of1], np.repeat(nothing, len(part), 0)]))
        rows.reshape(-1)[context] = used + np.arange(len(context))
    return TrieModel(symbols, rows.reshape(-1), np.concatenate(tables), deep, pairs)


def _loose_logs(batches: Iterable[pa.RecordBatch], shared: object) -> Iterator[pa.RecordBatch]:
    """(code, log) of the asked codes of (code, n, asked), which stand sorted with whole contexts in a partition."""
    symbols, pairs = shared.value
    size = pairs.shape[1]
    wide = size + 1
    singles = pairs.reshape(wide, wide, size).sum(axis=0)
    nothing = singles.sum(axis=0, keepdims=True)

    def logs(code: np.ndarray, n: np.ndarray, asked: np.ndarray) -> pa.RecordBatch:
        out = np.zeros(len(code))
        _, place = np.unique(code >> 8, return_inverse=True)
        a, b, c, d = _parts(symbols, code, 4)
        cuts = np.searchsorted(place, np.arange(0, place[-1] + 1025, 1024)) if len(code) else []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            inner = place[lo:hi] - place[lo]
            first = lo + np.searchsorted(inner, np.arange(inner[-1] + 1))
            triples = np.zeros((len(first), size + 1))  # asked symbols that no training text has go last, with no count
            np.add.at(triples, (inner, d[lo:hi]), n[lo:hi])
            of2 = b[first] * wide + c[first]
            stack = [triples[:, :size], pairs[of2], singles[c[first]], np.repeat(nothing, len(first), 0)]
            out[lo:hi] = _logs_of(stack)[inner, d[lo:hi]]
        return pa.record_batch([pa.array(code[asked]), pa.array(out[asked])], ["code", "log"])

    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
    for batch in batches:
        new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("code", "n", "asked")]
        held = [np.concatenate(x) for x in zip(held, new)]
        if len(held[0]):  # the last context may go on in the next batch
            cut = int(np.searchsorted(held[0] >> 8, held[0][-1] >> 8))
            yield logs(*(x[:cut] for x in held))
            held = [x[cut:] for x in held]
    yield logs(*held)


def _deep_logs(
    model: TrieModel, data: np.ndarray, offsets: np.ndarray, joined: bool
) -> tuple[np.ndarray, list[np.ndarray]]:
    """log10 probability of each text, its end included, and its codes (with times << 32) that are left to a join."""
    s, starts = _stream(data, offsets)
    sym = model.symbols[s]
    wide = model.logs.shape[1]
    context = (sym[:-3] * wide + sym[1:-2]) * wide + sym[2:-1]
    row = model.rows[context]
    each = model.logs[row, sym[3:]].astype(np.float64)
    begin, end = starts - 3, starts - 2 + np.diff(offsets)
    if not joined:
        return segment_sums(each, begin, end), [np.zeros(0, np.int64)] * len(starts)
    loose = np.flatnonzero(row < model.deep)
    owner = np.searchsorted(begin, loose, side="right") - 1
    inside = (owner >= 0) & (loose < end[owner])  # edges before a text are not predicted
    loose, owner = loose[inside], owner[inside]
    each[loose] = 0.0
    code = np.zeros(len(loose), dtype=np.int64)
    for k in range(4):
        code = code << 8 | s[loose + k]
    keys, times = np.unique(owner.astype(np.int64) << 32 | code, return_counts=True)
    cuts = np.searchsorted(keys >> 32, np.arange(len(starts) + 1))
    packed = times.astype(np.int64) << 32 | keys & 0xFFFFFFFF
    return segment_sums(each, begin, end), [packed[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def text_logs(model: TrieModel, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """log10 probability of each text, its end included."""
    return _deep_logs(model, data, offsets, False)[0]


def _scored(batches: Iterable[pa.RecordBatch], shared: object) -> Iterator[pa.RecordBatch]:
    model, keys, known, scale, joined = shared.value
    for rows, data, offsets in text_chunks(batches):
        small = lower(data)
        first, last, of = word_spans(small, offsets)
        words = SpanHash(small)(first, last)
        at = np.minimum(np.searchsorted(keys, words), max(len(keys) - 1, 0))
        common = keys[at] == words if len(keys) else np.zeros(len(words), dtype=bool)
        logs = np.zeros(len(words))
        logs[common] = np.log10((known[at[common]] + 0.1) / scale)
        many = np.concatenate([[0], np.cumsum(common)])
        rare = np.flatnonzero(~common)
        cuts = np.searchsorted(rare, of)
        rest = words[rare]
        near, loose = _deep_logs(model, data, offsets, joined)
        yield pa.record_batch(
            [
                rows.column("rid"),
                rows.column("doc_id"),
                rows.column("held_out"),
                pa.array(np.diff(of) + 1, pa.int64()),
                pa.array(many[of[1:]] - many[of[:-1]], pa.int64()),
                pa.array(segment_sums(logs, of[:-1], of[1:]), pa.float64()),
                pa.array(near, pa.float64()),
                longs([rest[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]),
                longs(loose),
            ],
            ["rid", "doc_id", "held_out", "n_tokens", "n_common", "common_score", "near_score", "rare", "loose"],
        )


def ppm_scores(
    docs: DataFrame, train: DataFrame, contexts: int = 1 << 15, common_words: int = 1 << 18
) -> DataFrame:
    """Scores of ``docs`` (doc_id, text, held_out) by models of the texts of ``train``.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigram model
    of lower-cased words and one end per text, add 0.1) and score (log10 probability of
    the bytes and the end of the text).  A null text is empty: one end.  Without training
    texts every byte has the same probability.

    Counts are of all training texts, and every three-byte context of them predicts.  At
    most ``contexts`` frequent contexts are broadcast; bytes in all others are joined.
    Counts of at most ``common_words`` frequent words are broadcast, those of all other
    words are joined.  Neither bound changes a result.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    counted = train.select(body).mapInArrow(_counted, "kind int, key bigint, n bigint")
    totals = stage(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    words, grams = totals.where(F.col("kind") == _WORDS), totals.where(F.col("kind") == _GRAMS)
    texts = train.count()
    sums = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens = int(sums.n or 0) + texts
    scale = tokens + 0.1 * (sums.v + (1 if texts else 0) + 1)

    # Frequent words: all above the least count that leaves no more than common_words.
    step = F.floor(F.log2("n") * 8).cast("int")
    floor_, kept = None, 0
    for row in words.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        if kept + row["count"] > common_words:
            break
        floor_, kept = row["step"], kept + row["count"]
    few = words.where(step >= floor_).select("key", "n").toPandas() if floor_ is not None else None
    keys = few["key"].to_numpy(np.int64).view(np.uint64) if few is not None else np.zeros(0, np.uint64)
    known = few["n"].to_numpy(np.int64) if few is not None else np.zeros(0, np.int64)
    order = np.argsort(keys)
    rare_counts = words.where(step < floor_) if floor_ is not None else words

    # Four-byte strings are 32-bit numbers, and shorter ones are sums of them: at most 2^24 triples.
    by_context = grams.groupBy(F.shiftright("key", 8).alias("c")).agg(F.sum("n").alias("n"))
    top = stage(by_context.orderBy(F.desc("n"), "c").limit(contexts), "contexts")
    joined = by_context.count() > contexts
    deep = grams.join(top.select("c"), F.shiftright("key", 8) == F.col("c"), "left_semi").select("key", "n").toPandas()
    low = grams.groupBy(F.col("key").bitwiseAND(F.lit(0xFFFFFF)).alias("key")).agg(F.sum("n").alias("n")).toPandas()
    model = build_trie(*(x.to_numpy(np.int64) for x in (deep["key"], deep["n"], low["key"], low["n"])))
    shared = spark.sparkContext.broadcast((replace(model, pairs=None), keys[order], known[order], scale, joined))

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", body)
    scored = stage(
        rows.mapInArrow(
            lambda it: _scored(it, shared),
            "rid bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_common bigint, common_score double, "
            "near_score double, rare array<bigint>, loose array<bigint>",
        ),
        "scored",
    )
    loose = scored.select("rid", F.explode("rare").alias("key")).join(rare_counts.select("key", "n"), "key", "left")
    rest = loose.groupBy("rid").agg(
        F.count("n").alias("n_rare"), F.sum(F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(scale))).alias("rare_score")
    )
    score = F.col("near_score")
    if joined:
        # Counts of the other contexts and the asked codes meet by context: at most 512 rows each.
        asked = scored.select("rid", F.explode("loose").alias("x")).select(
            "rid", F.col("x").bitwiseAND(F.lit(0xFFFFFFFF)).alias("code"), F.shiftright("x", 32).alias("times")
        )
        others = grams.join(top.select("c"), F.shiftright("key", 8) == F.col("c"), "left_anti")
        both = others.select(F.col("key").alias("code"), "n", F.lit(False).alias("asked")).unionByName(
            asked.select("code").distinct().select("code", F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("asked"))
        )
        both = both.repartition(F.shiftright("code", 8)).sortWithinPartitions("code")
        lower_counts = spark.sparkContext.broadcast((model.symbols, model.pairs))
        logs = both.mapInArrow(lambda it: _loose_logs(it, lower_counts), "code bigint, log double")
        deep_rest = asked.join(logs, "code").groupBy("rid").agg(F.sum(F.col("times") * F.col("log")).alias("far_score"))
        scored = scored.join(deep_rest, "rid", "left")
        score = score + F.coalesce("far_score", F.lit(0.0))
    end_log = float(np.log10((texts + 0.1) / scale))
    return scored.join(rest, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_common") + F.coalesce("n_rare", F.lit(0)) + (1 if texts else 0)).alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("common_score") + F.coalesce("rare_score", F.lit(0.0)) + F.lit(end_log)).alias("base_score"),
        score.alias("score"),
    )
