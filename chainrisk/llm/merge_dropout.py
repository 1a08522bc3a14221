"""SentencePiece merge encoding with seeded merge dropout, and lossless decoding.

A text gets one space in front, spaces become the space piece, and known characters
become pieces; all other characters become byte pieces.  Then the best pair of
neighbours merges, again and again, as an agenda would deliver it: highest score
first, leftmost of equals.  A candidate is skipped by a keyed hash of the seed, the
document (doc_id, copy and all bytes of its text), the word's place in the text, and the
candidate (place in its word and the two pieces), so the same copy of a document always
gets the same pieces, and every occurrence of a word is drawn by itself.

No piece joins text across a space before a word or a newline, so words are encoded by
themselves.  Each different word of a batch is merged once without dropout; occurrences in
which none of its merges is skipped share that result, all others are merged anew, all of
them together.  Words of over LONG symbols take the agenda one by one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainrisk.llm.arrays import SpanHash, mix, text_chunks

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 1 << 20
LONG = 48
OCCURRENCES = 1 << 16
_SPACE_MARK = 0x2581
_NEVER = np.int64(1) << np.int64(62)


class Merges:
    """Pieces and merge rules of a SentencePiece merge model (identity normalizer, byte fallback)."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(size)]
        ids = {p: i for i, p in enumerate(pieces) if plain[i]}
        if any("\n" in p and p != "\n" or chr(_SPACE_MARK) in p.lstrip(chr(_SPACE_MARK)) for p in ids):
            raise ValueError("pieces must not cross spaces or newlines")
        byte = {int(p[3:5], 16): i for i, p in enumerate(pieces) if model.is_byte(i)}
        if len(byte) != 256:
            raise ValueError("the model needs a piece for every byte")
        self.byte_ids = np.array([byte[b] for b in range(256)], dtype=np.int64)
        self.char_ids = np.full(0x110000, -1, dtype=np.int32)
        for p, i in ids.items():
            if len(p) == 1 and ord(p) != _SPACE_MARK:
                self.char_ids[ord(p)] = i
        if chr(_SPACE_MARK) in ids:
            self.char_ids[0x20] = ids[chr(_SPACE_MARK)]
        # Rank of a merged piece: by falling score, then by id.
        order = sorted(ids.values(), key=lambda i: (-model.get_score(i), i))
        rank, last = {}, None
        for n, i in enumerate(order):
            if model.get_score(i) != last:
                last, place = model.get_score(i), n
            rank[i] = place
        rules = sorted(
            (ids[p[:k]] * size + ids[p[k:]], rank[i], i)
            for p, i in ids.items()
            for k in range(1, len(p))
            if p[:k] in ids and p[k:] in ids
        )
        self.size = size
        self.pairs = {pair: (r, i) for pair, r, i in rules}
        self._table(np.array([r[0] for r in rules], np.int64), np.array([r[1] for r in rules], np.int64), np.array([r[2] for r in rules], np.int64))
        raw = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(chr(_SPACE_MARK), " ").encode() if plain[i] else b"" for i, p in enumerate(pieces)]
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.starts = np.cumsum([0, *map(len, raw)])

    def _table(self, pairs: np.ndarray, ranks: np.ndarray, merged: np.ndarray) -> None:
        """Open hash table of the rules; the longest probe is known."""
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.slot_pair = np.full(1 << self.bits, -1, dtype=np.int64)
        self.slot_rule = np.zeros(1 << self.bits, dtype=np.int64)
        left, probe = np.arange(len(pairs)), 0
        while len(left):
            slot = self._slot(pairs[left], probe)
            free = self.slot_pair[slot] < 0
            self.slot_pair[slot[free]] = pairs[left[free]]
            won = self.slot_pair[slot] == pairs[left]
            self.slot_rule[slot[won]] = ranks[left[won]] << 32 | merged[left[won]]
            left, probe = left[~won], probe + 1
        self.probes = probe

    def _slot(self, pairs: np.ndarray, probe: int) -> np.ndarray:
        home = mix(pairs.astype(np.uint64)) >> np.uint64(64 - self.bits)
        return (home.astype(np.int64) + probe) & ((1 << self.bits) - 1)

    def rules(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 32 | merged piece of neighbouring pieces, or _NEVER."""
        pairs = left * self.size + right
        out = np.full(len(pairs), _NEVER, dtype=np.int64)
        open_ = np.arange(len(pairs))
        for probe in range(self.probes):
            slot = self._slot(pairs[open_], probe)
            held = self.slot_pair[slot]
            hit = held == pairs[open_]
            out[open_[hit]] = self.slot_rule[slot[hit]]
            open_ = open_[~hit & (held >= 0)]
            if not len(open_):
                break
        return out


@lru_cache(maxsize=2)
def load_merges(path: str) -> Merges:
    return Merges(path)


def _skipped(key: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, limit: int) -> np.ndarray:
    """Whether candidates are skipped: a keyed hash of place and pieces below ``limit`` of 2^32."""
    pair = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
    return (mix(mix(key + at.astype(np.uint64)) ^ pair) >> np.uint64(32)) < np.uint64(limit)


def encode_agenda(m: Merges, symbols: list[int], key: int, limit: int) -> list[int]:
    """One word's pieces, by a heap."""
    n = len(symbols)
    ids, nxt, prv = list(symbols), [*range(1, n), -1], list(range(-1, n - 1))
    keys = np.array([key], np.uint64)
    agenda: list[tuple[int, int, int, int, int]] = []

    def add(i: int) -> None:
        j = nxt[i] if i >= 0 else -1
        if i < 0 or j < 0:
            return
        rule = m.pairs.get(ids[i] * m.size + ids[j])
        if rule:
            heapq.heappush(agenda, (rule[0], i, ids[i], ids[j], rule[1]))

    for i in range(n - 1):
        add(i)
    while agenda:
        _, i, a, b, merged = heapq.heappop(agenda)
        j = nxt[i]
        if ids[i] != a or j < 0 or ids[j] != b:
            continue  # one of the two has merged meanwhile
        if limit and _skipped(keys, np.array([i]), np.array([a]), np.array([b]), limit)[0]:
            continue
        ids[i], ids[j] = merged, -1
        nxt[i] = nxt[j]
        if nxt[j] >= 0:
            prv[nxt[j]] = i
        nxt[j] = -1
        add(prv[i])
        add(i)
    return [x for x in ids if x >= 0]


def encode_words(
    m: Merges, ids: np.ndarray, starts: np.ndarray, keys: np.ndarray, limit: int, merges: list | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of many words at once: symbols one after another, and where each word's begin (one more).

    ``merges`` takes the merges that were done: words, places in them, left and right pieces.
    """
    n = len(starts) - 1
    done: dict[str, list[np.ndarray]] = {"word": [], "ids": []}
    sizes = np.diff(starts)
    for w in np.flatnonzero(sizes > LONG).tolist():
        got = encode_agenda(m, ids[starts[w] : starts[w + 1]].tolist(), int(keys[w]), limit)
        done["word"].append(np.full(len(got), w))
        done["ids"].append(np.array(got, np.int64))
    word = np.repeat(np.arange(n), sizes)
    short = sizes[word] <= LONG
    word, ids = word[short], ids[short].astype(np.int64)
    at = np.arange(len(short))[short] - starts[word]

    def candidates(where: np.ndarray) -> np.ndarray:
        """Rules of the pairs that begin at the given places; the last symbol of all has none."""
        out = np.full(len(where), _NEVER, dtype=np.int64)
        inner = np.flatnonzero(where < len(ids) - 1)
        inner = inner[word[where[inner]] == word[where[inner] + 1]]
        i = where[inner]
        rule = m.rules(ids[i], ids[i + 1])
        if limit:
            some = np.flatnonzero(rule != _NEVER)
            i = i[some]
            rule[some[_skipped(keys[word[i]], at[i], ids[i], ids[i + 1], limit)]] = _NEVER
        out[inner] = rule
        return out

    rule = candidates(np.arange(len(ids)))
    while len(ids):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        best = np.minimum.reduceat(rule >> 32, first)
        open_ = best < (_NEVER >> 32)
        count = np.diff(np.append(first, len(ids)))
        over = np.repeat(~open_, count)
        if over.any():
            done["word"].append(word[over])
            done["ids"].append(ids[over])
        hit = np.flatnonzero((rule >> 32 == np.repeat(best, count)) & ~over)
        if not len(hit):
            break
        lead = hit[np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])]  # the leftmost of each word
        if merges is not None:
            merges.append((word[lead], at[lead], ids[lead], ids[lead + 1]))
        ids[lead] = rule[lead] & 0xFFFFFFFF
        stay = ~over
        stay[lead + 1] = False
        place = np.cumsum(stay) - 1
        word, ids, at, rule = word[stay], ids[stay], at[stay], rule[stay]
        merged = place[lead]
        touched = np.zeros(len(ids), dtype=bool)
        touched[merged] = touched[np.maximum(merged - 1, 0)] = True
        touched = np.flatnonzero(touched)
        rule[touched] = candidates(touched)
    words = np.concatenate([np.zeros(0, np.int64), *done["word"]])
    pieces = np.concatenate([np.zeros(0, np.int64), *done["ids"]])
    order = np.argsort(words, kind="stable")
    return pieces[order], np.searchsorted(words[order], np.arange(n + 1))


def _gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Spans of an array one after another."""
    sizes = ends - starts
    skip = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else starts, sizes)
    return data[np.arange(int(sizes.sum())) + skip]


def _encode_occurrences(
    m: Merges, ids: np.ndarray, starts: np.ndarray, word: np.ndarray, keys: np.ndarray, limit: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces, and where those of each occurrence begin and end; ``word`` is its word, ``keys`` its own key."""
    sizes = np.diff(starts)
    short = np.flatnonzero(sizes <= LONG)
    slot = np.full(len(sizes), -1, dtype=np.int64)
    slot[short] = np.arange(len(short))
    merges: list = []
    ahead = np.concatenate([[0], np.cumsum(sizes[short])])
    shared, where = encode_words(m, _gather(ids, starts[short], starts[short + 1]), ahead, np.zeros(len(short), np.uint64), 0, merges)
    own = slot[word]
    fresh = own < 0
    if merges:
        of, at, left, right = (np.concatenate(x) for x in zip(*merges))
        order = np.argsort(of, kind="stable")
        at, left, right = at[order], left[order], right[order]
        first = np.searchsorted(of[order], np.arange(len(short) + 1))
        for begin in range(0, len(word), OCCURRENCES):
            some = begin + np.flatnonzero(own[begin : begin + OCCURRENCES] >= 0)
            lo, count = first[own[some]], np.diff(first)[own[some]]
            which = np.repeat(some, count)
            step = np.arange(len(which)) + np.repeat(lo - (np.cumsum(count) - count), count)
            fresh[which[_skipped(keys[which], at[step], left[step], right[step], limit)]] = True
    anew = np.flatnonzero(fresh)
    w = word[anew]
    ahead = np.concatenate([[0], np.cumsum(sizes[w])])
    drawn, at = encode_words(m, _gather(ids, starts[w], starts[w + 1]), ahead, keys[anew], limit)
    lo, hi = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
    same = np.flatnonzero(~fresh)
    lo[same], hi[same] = where[own[same]], where[own[same] + 1]
    lo[anew], hi[anew] = len(shared) + at[:-1], len(shared) + at[1:]
    return np.concatenate([shared, drawn]), lo, hi


def encode_texts(
    m: Merges, data: np.ndarray, offsets: np.ndarray, variants: np.ndarray, seed: int, limit: int
) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of all texts and where each text's begin; ``variants`` has one number per text, from all 64 bits."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    lead = (sizes > 0).astype(np.int64)  # the space in front
    begin = offsets[:-1] + np.concatenate([[0], np.cumsum(lead)[:-1]])
    s = np.full(len(data) + int(lead.sum()), 0x20, dtype=np.uint8)
    s[np.arange(len(data)) + np.repeat(np.cumsum(lead), sizes)] = data
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    space, line = s == 0x20, s == 0x0A
    opens = line | (space & ~np.concatenate([[False], space[:-1]])) | np.concatenate([[True], line[:-1]])
    opens[begin[sizes > 0]] = True
    starts = np.flatnonzero(opens)
    ends = np.append(starts[1:], len(s))
    text = np.searchsorted(begin, starts, side="right") - 1
    # Among texts that begin at the same place only the last has symbols.
    key = mix(mix(variants[text].astype(np.uint64) + np.uint64(1)) + np.uint64(seed % (1 << 63)))
    place = np.arange(len(starts)) - np.searchsorted(text, text)
    word_hash = SpanHash(s)(starts, ends)
    key = mix(mix(key + place.astype(np.uint64)) ^ word_hash)
    _, pick, back = np.unique(word_hash, return_index=True, return_inverse=True)
    chosen = _gather(s, starts[pick], ends[pick])
    points = np.frombuffer(chosen.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    ids = m.char_ids[points].astype(np.int64)
    opening = (chosen & 0xC0) != 0x80
    byte_sizes = np.concatenate([[0], np.cumsum(ends[pick] - starts[pick])])
    char_at = np.concatenate([[0], np.cumsum(opening)])[byte_sizes]
    if (ids < 0).any():  # characters without a piece become their bytes
        char_start = np.flatnonzero(opening)
        width = np.diff(np.append(char_start, len(chosen)))
        copies = np.where(ids < 0, width, 1)
        source = np.repeat(np.arange(len(ids)), copies)
        inner = np.arange(len(source)) - np.repeat(np.cumsum(copies) - copies, copies)
        known = ids[source]
        as_bytes = m.byte_ids[chosen[char_start[source] + inner]]
        char_at = np.concatenate([[0], np.cumsum(copies)])[char_at]
        ids = np.where(known < 0, as_bytes, known)
    if limit:
        pieces, lo, hi = _encode_occurrences(m, ids, char_at, back, key, limit)
    else:
        pieces, where = encode_words(m, ids, char_at, key[pick], limit)
        lo, hi = where[back], where[back + 1]
    out = _gather(pieces, lo, hi)
    ahead = np.concatenate([[0], np.cumsum(hi - lo)])
    return out, ahead[np.searchsorted(text, np.arange(n + 1))]


def decode_texts(m: Merges, pieces: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each begins, without the space in front."""
    lo, hi = m.starts[pieces], m.starts[pieces + 1]
    raw = _gather(m.bytes, lo, hi)
    ahead = np.concatenate([[0], np.cumsum(hi - lo)])[starts]
    keep = np.ones(len(raw), dtype=bool)
    some = np.flatnonzero(np.diff(ahead) > 0)
    keep[ahead[some]] = False
    return raw[keep], ahead - np.searchsorted(ahead[some], ahead)


def _local(path: str) -> str:
    return path if path.startswith("/") else SparkFiles.get(path)


def _encode(batches: Iterable[pa.RecordBatch], path: str, seed: int, limit: int) -> Iterator[pa.RecordBatch]:
    m = load_merges(_local(path))
    for rows, data, offsets in text_chunks(batches, column="body", limit=CHUNK):
        salt = rows.column("salt").to_numpy(zero_copy_only=False).view(np.uint64)
        own = mix(SpanHash(data)(offsets[:-1], offsets[1:]) ^ mix(salt))
        pieces, starts = encode_texts(m, data, offsets, own, seed, limit)
        back, at = decode_texts(m, pieces, starts)
        same_size = np.diff(at) == np.diff(offsets)
        if len(back) == len(data) and same_size.all():
            wrong = np.concatenate([[0], np.cumsum(back != data)])
            lossless = wrong[offsets[1:]] == wrong[offsets[:-1]]
        else:
            lossless = np.array([ok and (back[a:b] == data[c:d]).all() for ok, a, b, c, d in zip(same_size, at[:-1], at[1:], offsets[:-1], offsets[1:])])
        kept = [c for c in rows.schema.names if c not in ("body", "salt")]
        ids = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(pieces.astype(np.int32)))
        yield pa.record_batch(
            [*(rows.column(c) for c in kept), pa.array(np.diff(offsets), pa.int64()), pa.array(np.diff(starts), pa.int64()), pa.array(own.view(np.int64)), pa.array(lossless, pa.bool_()), ids],
            [*kept, "n_bytes", "n_tokens", "variant", "lossless", "ids"],
        )


def encode_documents(
    docs: DataFrame,
    carry: tuple[str, ...] = ("doc_id",),
    dropout: float = 0.1,
    seed: int = 1,
    copy: str | None = None,
    model_path: str = MODEL_PATH,
) -> DataFrame:
    """The ``carry`` columns with n_bytes, n_tokens, variant, lossless and ids of each whole text.

    ``dropout`` is the share of merge candidates that are skipped.  A row's variant is a
    hash of doc_id, ``copy`` (a column that numbers the copies of a document) and the bytes of
    the text; every word of a text is drawn by variant and place, so nothing bounds how many
    ways of cutting a word are drawn.  Rows equal in these get equal pieces.
    ``lossless`` tells whether the pieces decode to the same bytes.  A null or empty text has
    no pieces.  ``model_path`` is an absolute path on every node, or a name given to addFile.
    """
    if not 0 <= dropout < 1:
        raise ValueError("dropout must be at least 0 and below 1")
    limit = int(dropout * (1 << 32))
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", *([copy] if copy else []))]
    salt = F.xxhash64(*named)
    rows = docs.select(*(F.col(c).alias(f"c_{c}") for c in carry), body.alias("body"), salt.alias("salt"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`c_{c}` {kinds[f'c_{c}']}" for c in carry)
    out = rows.mapInArrow(
        lambda it: _encode(it, model_path, seed, limit),
        f"{schema}, n_bytes bigint, n_tokens bigint, variant bigint, lossless boolean, ids array<int>",
    )
    return out.select(*(F.col(f"c_{c}").alias(c) for c in carry), "n_bytes", "n_tokens", "variant", "lossless", "ids")


def _decode(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    m = load_merges(_local(path))
    for rows in batches:
        column = rows.column("ids")
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.array([0 if x is None else x for x in column.value_lengths().to_pylist()], dtype=np.int64)
        raw, at = decode_texts(m, flat, np.concatenate([[0], np.cumsum(sizes)]))
        data = raw.tobytes()
        kept = [c for c in rows.schema.names if c != "ids"]
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        yield pa.record_batch([*(rows.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, "text"])


def decode_documents(encoded: DataFrame, carry: tuple[str, ...] = ("doc_id",), model_path: str = MODEL_PATH) -> DataFrame:
    """The ``carry`` columns with the text of ``ids``; null ids give the empty text."""
    rows = encoded.select(*(F.col(c).alias(f"c_{c}") for c in carry), "ids")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`c_{c}` {kinds[f'c_{c}']}" for c in carry)
    out = rows.mapInArrow(lambda it: _decode(it, model_path), f"{schema}, text string")
    return out.select(*(F.col(f"c_{c}").alias(c) for c in carry), "text")
