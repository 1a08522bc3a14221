"""Removal of byte strings that occur more than once, by run-length indexes.

A byte is removed if a string of ``length`` bytes that covers it starts anywhere
else too.  Matches never cross texts.

1. Anchors, short grams chosen by their hash, are counted over the whole corpus.
2. Every window of ``length`` bytes goes by its rarest anchor, a choice that
   depends on the window alone, so equal windows meet in one bucket.  A window with
   an anchor that occurs once is unique and stays at home.  Neighbouring windows
   with the same anchor travel as one string.
3. Each bucket collapses equal strings and builds over the rest a run-length
   encoded Burrows-Wheeler transform that keeps text positions and match lengths
   at run heads and run ends only.  Between those samples the matching statistics
   fall by one per byte, so one stream over the text yields them all.
4. Windows whose rarest anchor is very frequent would make one bucket hot.  All of
   them lie inside passages that very many texts share; they are compared by digest,
   and those that occur twice in one task are settled there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainrisk.llm.arrays import SpanHash, mix, text_chunks
from chainrisk.llm.levels import bucket_bits, corpus_levels, level_of

GRAM = 32
_RARE = np.uint64((1 << 64) // 16)  # one gram in 16 is an anchor
#: Least counts of levels; anchors of level 3 are the very frequent ones.
STEPS = (2, 64, 4096)
_ZSTD = pa.Codec("zstd", 1)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
CHUNK = 1 << 20
FLUSH_BYTES = 1 << 24
FLUSH_WINDOWS = 1 << 20
INDEX_BYTES = 1 << 20
NO_ID = -(1 << 63)
_WINDOW_KIND, _STRING_KIND, _SPAN_KIND = 0, 1, 2


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    y = x
    while span * 2 <= width:
        y = np.minimum(y[:-span], y[span:])
        span *= 2
    count = len(x) - width + 1
    return np.minimum(y[:count], y[width - span : width - span + count])


def _valid_starts(offsets: np.ndarray, length: int, count: int) -> np.ndarray:
    """Window starts whose window lies in one text."""
    step = np.zeros(count + 1, dtype=np.int32)
    lo, hi = offsets[:-1], offsets[1:] - length + 1
    ok = hi > lo
    np.add.at(step, lo[ok], 1)
    np.add.at(step, hi[ok], -1)
    return np.cumsum(step[:-1]) > 0


def _runs(flags: np.ndarray, values: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of runs of true flags (with equal values)."""
    where = np.flatnonzero(flags)
    if not len(where):
        return where, where
    cut = np.diff(where) > 1
    if values is not None:
        v = values[where]
        cut |= v[1:] != v[:-1]
    cuts = np.flatnonzero(cut)
    return where[np.append(0, cuts + 1)], where[np.append(cuts, len(where) - 1)]


def _anchors(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[np.ndarray]:
    """Hashes of all anchor occurrences: rare-hash grams, else the least gram of a window."""
    width = length - GRAM + 1
    for _, data, offsets in text_chunks(batches, limit=CHUNK):
        if len(data) < length:
            continue
        grams = SpanHash(data).grams(GRAM)
        inside = _valid_starts(offsets, GRAM, len(grams))
        long_enough = np.repeat(np.diff(offsets) >= length, np.diff(offsets))[: len(grams)]
        yield grams[inside & long_enough & (grams < _RARE)]
        low = _sliding_min(grams, width)
        bare = _valid_starts(offsets, length, len(low)) & (low >= _RARE)
        for a, b in zip(*_runs(bare, low)):
            part = grams[a : b + width]
            yield part[part == low[a]]


class _Outbox:
    """Collects strings, single windows and settled spans of a task and packs them by bucket."""

    def __init__(self, bits: int, length: int) -> None:
        self.bits, self.length = bits, length
        self.strings: list[tuple] = []
        self.windows: list[tuple] = []
        self.bytes = self.count = 0

    @staticmethod
    def _row(bucket: int, kind: int, keys, rid, tag, start, size, data: bytes = b"") -> tuple:
        cols = (keys.astype(np.uint64), rid.astype(np.int64), tag.astype(np.int64), start.astype(np.int64), size.astype(np.int64))
        return (bucket, kind, *(c.tobytes() for c in cols), data)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 6
        names = ["bucket", "kind", "keys", "rid", "tag", "start", "size", "data"]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def flush_strings(self) -> Iterator[pa.RecordBatch]:
        if not self.strings:
            return
        keys, rid, tag, start, size = (np.concatenate([s[k] for s in self.strings]) for k in range(5))
        texts = [t for s in self.strings for t in s[5]]
        home = mix(keys) >> np.uint64(64 - self.bits)
        order = np.argsort(home, kind="stable")
        rows = []
        for part in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
            data = _ZSTD.compress(b"".join([texts[i] for i in part]), asbytes=True)
            rows.append(self._row(int(home[part[0]]), _STRING_KIND, keys[part], rid[part], tag[part], start[part], size[part], data))
        self.strings, self.bytes = [], 0
        yield self.batch(rows)

    def flush_windows(self) -> Iterator[pa.RecordBatch]:
        if not self.windows:
            return
        one, two, rid, tag, start = (np.concatenate([w[k] for w in self.windows]) for k in range(5))
        self.windows, self.count = [], 0
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        group = np.cumsum(new) - 1
        many = np.bincount(group) > 1
        rows = []
        twice = order[many[group]]
        if len(twice):
            twice = np.sort(twice)  # text order: neighbouring windows make one span
            cut = (np.diff(start[twice]) != 1) | (np.diff(rid[twice]) != 0) | (np.diff(tag[twice]) != 0)
            cuts = np.flatnonzero(cut)
            first, last = twice[np.append(0, cuts + 1)], twice[np.append(cuts, len(twice) - 1)]
            size = start[last] - start[first] + self.length
            # Settled spans are only passed through: each text has a bucket of its own hash.
            home = mix(rid[first].view(np.uint64) ^ mix(tag[first].view(np.uint64))) >> np.uint64(64 - self.bits)
            by_home = np.argsort(home, kind="stable")
            for part in np.split(by_home, np.flatnonzero(np.diff(home[by_home])) + 1):
                at = first[part]
                rows.append(self._row(int(home[part[0]]), _SPAN_KIND, np.zeros(len(part)), rid[at], tag[at], start[at], size[part]))
        # One window of each digest goes on; those seen twice here stand for two.
        lead = order[np.flatnonzero(new)]
        weight = np.where(many, 2, 1)
        home = one[lead] >> np.uint64(64 - self.bits)
        for part in np.split(np.arange(len(lead)), np.flatnonzero(np.diff(home)) + 1):
            at = lead[part]
            rows.append(self._row(int(home[part[0]]), _WINDOW_KIND, one[at], rid[at], tag[at], start[at], weight[part], two[at].tobytes()))
        yield self.batch(rows)


def _deal(batches: Iterable[pa.RecordBatch], table: object, length: int, bits: int) -> Iterator[pa.RecordBatch]:
    width = length - GRAM + 1
    out = _Outbox(bits, length)
    for rows, data, offsets in text_chunks(batches, limit=CHUNK):
        if len(data) < length:
            continue
        spans = SpanHash(data)
        grams = spans.grams(GRAM)
        order = np.full(len(grams), _NONE)
        rare = np.flatnonzero(grams < _RARE)
        h = grams[rare]
        order[rare] = level_of(table.value, h) << np.uint64(62) | h >> np.uint64(2)
        key = _sliding_min(order, width)
        bare = np.flatnonzero(key == _NONE)
        if len(bare):
            low = _sliding_min(grams, width)[bare]
            key[bare] = level_of(table.value, low) << np.uint64(62) | low >> np.uint64(2)
        level = key >> np.uint64(62)
        valid = _valid_starts(offsets, length, len(key))
        rid = rows.column("rid").to_numpy(zero_copy_only=False)
        tag = rows.column("tag").to_numpy(zero_copy_only=False)

        first, last = _runs(valid & (level > 0) & (level < 3), key)
        if len(first):
            owner = np.searchsorted(offsets, first, side="right") - 1
            ends = last + length
            raw = data.tobytes()
            # Anchors of the run's key inside it: with one alone no window of the run equals another of it.
            lo, hi = np.searchsorted(rare, first), np.searchsorted(rare, last + width)
            run = np.repeat(np.arange(len(first)), hi - lo)
            at = np.arange(len(run)) + np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo)
            held = np.bincount(run[order[rare[at]] == key[first][run]], minlength=len(first))
            size = (ends - first) * 2 + (held != 1)
            out.strings.append(
                (key[first], rid[owner], tag[owner], first - offsets[owner], size, [raw[a:b] for a, b in zip(first.tolist(), ends.tolist())])
            )
            out.bytes += int((ends - first).sum())
        hot = np.flatnonzero(valid & (level == 3))
        if len(hot):
            owner = np.searchsorted(offsets, hot, side="right") - 1
            half = hot + length // 2
            out.windows.append((spans(hot, half), spans(half, hot + length), rid[owner], tag[owner], hot - offsets[owner]))
            out.count += len(hot)
        if out.bytes >= FLUSH_BYTES:
            yield from out.flush_strings()
        if out.count >= FLUSH_WINDOWS:
            yield from out.flush_windows()
    yield from out.flush_strings()
    yield from out.flush_windows()


class RunLengthIndex:
    """Run-length encoded Burrows-Wheeler transform of distinct strings, with sampled run ends.

    ``data`` holds the strings one after another, ``offsets`` where each starts.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        sa = self._suffixes()
        before = data[sa - 1].astype(np.int16)
        opening = np.zeros(len(data), dtype=bool)
        opening[offsets[:-1]] = True
        before[opening[sa]] = -1  # a string's first suffix: nothing stands before it
        fresh = np.ones(len(sa), dtype=bool)
        fresh[1:] = (before[1:] != before[:-1]) | (before[1:] < 0)
        heads = np.flatnonzero(fresh)
        ends = np.append(heads[1:], len(sa)) - 1
        #: The transform: a symbol and a length per run (-1 where nothing stands before).
        self.symbols, self.lengths = before[heads], ends - heads + 1
        #: Text positions at run heads and run ends, and how far each matches its outer neighbour.
        self.head_at, self.end_at = sa[heads], sa[ends]
        self.head_match = np.zeros(len(heads), dtype=np.int64)
        self.end_match = np.zeros(len(heads), dtype=np.int64)
        common = self._common(sa[heads[1:]], sa[heads[1:] - 1])
        self.head_match[1:] = common
        self.end_match[:-1] = common

    def _suffixes(self) -> np.ndarray:
        """Suffix array; suffixes end with their string, equal ones stand in text order."""
        n = len(self.data)
        lengths = np.diff(self.offsets)
        stop = np.repeat(self.offsets[1:], lengths).astype(np.int32)
        left = stop - np.arange(n, dtype=np.int32)
        key = np.zeros(n, dtype=np.uint64)
        padded = np.concatenate([self.data.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64)])
        for k in range(7):
            key = key << np.uint64(9) | np.where(left > k, padded[k : k + n], np.uint64(0))
        sa = np.argsort(key, kind="stable").astype(np.int32)
        key = key[sa]
        rank = np.empty(n, dtype=np.int32)
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        slots = np.flatnonzero(~(new & np.append(new[1:], True)))
        reach, longest = 7, int(lengths.max())
        while len(slots) and reach < longest:
            at = sa[slots]
            ahead = at + reach
            later = np.where(ahead < stop[at], rank[np.minimum(ahead, n - 1)] + 1, 0)
            key = rank[at].astype(np.int64) << 32 | later
            o = np.argsort(key, kind="stable")
            at, key = at[o], key[o]
            sa[slots] = at
            new = np.concatenate([[True], key[1:] != key[:-1]])
            rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            slots = slots[~(new & np.append(new[1:], True))]
            reach *= 2
        if len(slots):
            at = sa[slots]
            sa[slots] = at[np.lexsort((at, rank[at]))]
        return sa

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of suffixes, by bisection on span hashes."""
        hashes = SpanHash(self.data)
        stop = np.repeat(self.offsets[1:], np.diff(self.offsets))
        low = np.zeros(len(a), dtype=np.int64)
        high = np.minimum(stop[a] - a, stop[b] - b)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            mid = (low[open_] + high[open_] + 1) // 2
            x, y = a[open_], b[open_]
            equal = hashes(x, x + mid) == hashes(y, y + mid)
            low[open_] = np.where(equal, mid, low[open_])
            high[open_] = np.where(equal, high[open_], mid - 1)

    def matching_statistics(self) -> np.ndarray:
        """For each position the longest match of its suffix with any other suffix."""
        n = len(self.data)
        steps = np.arange(n)
        best = np.zeros(n, dtype=np.int64)
        for at, match in ((self.head_at, self.head_match), (self.end_at, self.end_match)):
            source = np.full(n, -1, dtype=np.int64)
            source[at] = at
            value = np.zeros(n, dtype=np.int64)
            value[at] = match
            source = np.maximum.accumulate(source)
            best = np.maximum(best, value[source] - (steps - source))
        return best


def _column(pdf: pd.DataFrame, name: str, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in pdf[name]]) if len(pdf) else np.zeros(0, kind)


def _string_spans(pdf: pd.DataFrame, length: int) -> Iterator[tuple]:
    keys, rid, tag = (_column(pdf, c, k) for c, k in (("keys", np.uint64), ("rid", np.int64), ("tag", np.int64)))
    start, size = _column(pdf, "start", np.int64), _column(pdf, "size", np.int64)
    several, size = (size & 1).astype(bool), size >> 1  # the low bit: the anchor may stand in the string more than once
    cuts = np.cumsum([0, *(len(x) // 8 for x in pdf["size"])])
    packs = [(x, int(size[a:b].sum())) for x, a, b in zip(pdf["data"], cuts[:-1], cuts[1:])]
    data = np.concatenate([np.frombuffer(_ZSTD.decompress(x, n, asbytes=True), np.uint8) for x, n in packs])
    where = np.concatenate([[0], np.cumsum(size)])
    ids = mix(SpanHash(data)(where[:-1], where[1:]) + mix(keys))
    _, lead, group, times = np.unique(ids, return_index=True, return_inverse=True, return_counts=True)
    full = times[group] > 1
    yield rid[full], tag[full], start[full], size[full]
    # Strings for the index: several of one anchor, or one that may match itself.
    _, anchor, kinds = np.unique(keys[lead], return_inverse=True, return_counts=True)
    chosen = np.flatnonzero((kinds[anchor] > 1) | ((times == 1) & several[lead] & (size[lead] > length)))
    chosen = chosen[np.argsort(anchor[chosen], kind="stable")]
    if not len(chosen):
        return
    # Indexes of about INDEX_BYTES, each of whole anchors.
    ahead = np.cumsum(size[lead[chosen]])
    owner = anchor[chosen]
    pack = np.zeros(len(chosen), dtype=np.int64)
    heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    pack[heads] = (ahead[heads] - size[lead[chosen[heads]]]) // INDEX_BYTES
    pack = np.maximum.accumulate(pack)
    for part in np.split(chosen, np.flatnonzero(np.diff(pack)) + 1):
        at = lead[part]
        offsets = np.concatenate([[0], np.cumsum(size[at])])
        joined = np.concatenate([data[where[i] : where[i + 1]] for i in at])
        match = RunLengthIndex(joined, offsets).matching_statistics()
        string = np.repeat(np.arange(len(part)), size[at])
        single = times[part] == 1
        first, last = _runs((match >= length) & single[string], string)
        if len(first):
            which = at[string[first]]
            inner = first - offsets[string[first]]
            yield rid[which], tag[which], start[which] + inner, last - first + length


def _window_spans(pdf: pd.DataFrame, length: int) -> Iterator[tuple]:
    one, two = _column(pdf, "keys", np.uint64), _column(pdf, "data", np.uint64)
    rid, tag = _column(pdf, "rid", np.int64), _column(pdf, "tag", np.int64)
    start, weight = _column(pdf, "start", np.int64), _column(pdf, "size", np.int64)
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    group = np.cumsum(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) - 1
    total = np.bincount(group, weights=weight[order])
    found = order[total[group] > 1]
    # Windows sent as a pair are settled where they came from; their lead is one of them.
    found = found[np.lexsort((start[found], tag[found], rid[found]))]
    if len(found):
        cut = (np.diff(start[found]) != 1) | (np.diff(rid[found]) != 0) | (np.diff(tag[found]) != 0)
        cuts = np.flatnonzero(cut)
        first, last = found[np.append(0, cuts + 1)], found[np.append(cuts, len(found) - 1)]
        yield rid[first], tag[first], start[first], start[last] - start[first] + length


def _bucket_spans(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    found: list[tuple] = []
    settled = pdf[pdf["kind"] == _SPAN_KIND]
    if len(settled):
        found.append(tuple(_column(settled, c, np.int64) for c in ("rid", "tag", "start", "size")))
    windows = pdf[pdf["kind"] == _WINDOW_KIND]
    if len(windows):
        found.extend(_window_spans(windows, length))
    strings = pdf[pdf["kind"] == _STRING_KIND]
    if len(strings):
        found.extend(_string_spans(strings, length))
    cols = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(4)]
    return pd.DataFrame(dict(zip(("rid", "tag", "start", "size"), cols)))


def _cut(batches: Iterable[pa.RecordBatch], as_text: bool) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in text_chunks(batches, column="body", limit=CHUNK):
        spans = rows.column("spans").to_pylist()
        raw = data.tobytes()
        out: dict[str, list] = {k: [] for k in ("removed", "runs", "kept")}
        for k, found in enumerate(spans):
            text = raw[offsets[k] : offsets[k + 1]]
            removed = runs = 0
            if found:
                kept, reach = [], 0
                for s in sorted(found, key=lambda s: s["start"]):
                    a, b = s["start"], s["start"] + s["size"]
                    if a > reach or not runs:
                        kept.append(text[reach:a])
                        removed += b - a
                        runs += 1
                        reach = b
                    elif b > reach:
                        removed += b - reach
                        reach = b
                kept.append(text[reach:])
                text = b"".join(kept)
            out["removed"].append(removed)
            out["runs"].append(runs)
            out["kept"].append(text.decode("utf-8", "ignore") if as_text else text)
        yield pa.record_batch(
            [
                *(rows.column(c) for c in rows.schema.names if c not in ("body", "spans")),
                pa.array(np.diff(offsets), pa.int64()),
                pa.array(out["removed"], pa.int64()),
                pa.array(out["runs"], pa.int64()),
                pa.array(out["kept"], pa.string() if as_text else pa.binary()),
            ],
            [*(c for c in rows.schema.names if c not in ("body", "spans")), "n_bytes", "n_removed", "n_spans", "kept"],
        )


def cut_repeats(
    docs: DataFrame, length: int = 200, carry: tuple[str, ...] = ("doc_id",), as_text: bool = False
) -> DataFrame:
    """The ``carry`` columns of ``docs`` with n_bytes, n_removed, n_spans and kept (the bytes left).

    Texts are UTF-8 bytes, null as empty; texts shorter than ``length`` lose nothing.
    Every string is judged on the input, equal rows count as two texts, and doc_id may
    be null or repeated.  ``as_text`` gives kept as text, without what is left of characters
    that lost a part.  Other columns are ignored.  Counts anchors in a job of its own.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    rid = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(rid.alias("rid"), F.xxhash64(body).alias("tag"), body.alias("text"))
    bits = bucket_bits(texts)
    table = corpus_levels(docs.select(body.alias("text")), lambda it: _anchors(it, length), STEPS)
    dealt = texts.mapInArrow(
        lambda it: _deal(it, table, length, bits),
        "bucket int, kind int, keys binary, rid binary, tag binary, start binary, size binary, data binary",
    )
    spans = dealt.groupBy("bucket").applyInPandas(
        lambda pdf: _bucket_spans(pdf, length), "rid bigint, tag bigint, start bigint, size bigint"
    )
    marks = spans.groupBy(F.col("rid").alias("m_rid"), F.col("tag").alias("m_tag")).agg(
        F.collect_set(F.struct("start", "size")).alias("spans")
    )
    whole = docs.select(
        *(F.col(c).alias(f"c_{c}") for c in carry), rid.alias("rid"), F.xxhash64(body).alias("tag"), body.alias("body")
    )
    joined = whole.join(marks, (F.col("rid") == F.col("m_rid")) & (F.col("tag") == F.col("m_tag")), "left").select(
        *(f"c_{c}" for c in carry), "body", "spans"
    )
    kinds = {f.name: f.dataType.simpleString() for f in joined.schema}
    schema = ", ".join(f"`c_{c}` {kinds[f'c_{c}']}" for c in carry)
    kept = "string" if as_text else "binary"
    cut = joined.mapInArrow(
        lambda it: _cut(it, as_text), f"{schema}, n_bytes bigint, n_removed bigint, n_spans bigint, kept {kept}"
    )
    return cut.select(*(F.col(f"c_{c}").alias(c) for c in carry), "n_bytes", "n_removed", "n_spans", "kept")
