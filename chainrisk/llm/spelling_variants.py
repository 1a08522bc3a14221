"""Spelling variants by reduced-alphabet neighbourhoods.

Letters are hashed to a few symbols, so a word has a short list of neighbours: all
words one edit away in the reduced alphabet.  Two words one edit apart are equal or
one edit apart when reduced, so every near pair is found where a neighbour of one
word meets the reduced form of the other.

An edit changes one half of a word and leaves the other as it is.  Each neighbour
therefore also carries the unchanged half, so that only words that share a half
meet, however many words share a reduced form.  What meets is compared letter by
letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainrisk.llm.arrays import mix
from chainrisk.llm.hashing import crc_sql, crc_table_sql
from chainrisk.sources.staging import stage

#: Symbols that letters are hashed to.
SYMBOLS = 4
#: One in this many (document, word) loses a letter, as given by the task.
DAMAGED = 97
#: Different words of a task counted at a time, and reduced neighbours written at a time.
COUNTED, WRITTEN = 1 << 17, 1 << 20
_RUN = re.compile(rb"(?:[a-z]+|(?:\xc3[\x80-\xbf])+)+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_PREFIX, _SUFFIX = 0x8CB92BA72F3D8DD7, 0x2545F4914F6CDD1D
_WORD = (1 << 64) - 1


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def flush() -> pa.RecordBatch:
        words = pa.array(list(held), pa.binary()).cast(pa.string())
        batch = pa.record_batch([words, pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return batch

    for batch in batches:
        ids = batch.column("doc_id")
        texts = batch.column("text").cast(pa.binary())
        for i in range(batch.num_rows):
            text = texts[i].as_py()
            if not text:
                continue
            seed = zlib.crc32((ids[i].as_py() or "").encode() + b":")
            found: Counter = Counter()
            runs = _RUN.finditer(text.translate(_LOWER))
            for run in runs:
                found[run[0]] += 1
                if len(found) >= COUNTED:
                    yield from _damaged(found, seed, held, flush)
            yield from _damaged(found, seed, held, flush)
    if held:
        yield flush()


def _damaged(found: Counter, seed: int, held: Counter, flush) -> Iterator[pa.RecordBatch]:
    """Add the runs of one document to the counts, some with a letter less."""
    for word, n in found.items():
        h = zlib.crc32(word, seed)
        if h % DAMAGED == 0:
            letters = word.decode()
            at = h % len(letters)
            word = (letters[:at] + letters[at + 1 :]).encode()
        held[word] += n
    found.clear()
    if len(held) >= COUNTED:
        yield flush()


def vocabulary(docs: DataFrame, shortest: int = 5, least: int = 3) -> DataFrame:
    """word and n: lower-cased letter runs of at least ``shortest`` letters and ``least`` occurrences.

    One in ``DAMAGED`` (doc_id, word) counts without one letter, as its checksum says.
    Counts are merged in the tasks before they are shuffled.
    """
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = texts.mapInArrow(_counts, "word string, n bigint").where(F.char_length("word") >= shortest)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _BACK):
        steps = np.full(n + 2, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def _sums(values: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Running polynomial sums of the rows of a matrix, a zero column first."""
    out = np.zeros((values.shape[0], values.shape[1] + 1), np.uint64)
    np.cumsum(values * up[: values.shape[1]], axis=1, dtype=np.uint64, out=out[:, 1:])
    return out


class _Words:
    """Words of one length as arrays: reduced symbols, their running sums, and hashes of halves."""

    def __init__(self, words: list[str], length: int) -> None:
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)
        codes = mix(letters.astype(np.uint64) + np.uint64(1))
        self.length = length
        self.up, self.down = _powers(length)
        self.symbols = (codes >> np.uint64(17)) % np.uint64(SYMBOLS) + np.uint64(1)
        self.reduced = _sums(self.symbols, self.up)
        self.exact = _sums(codes, self.up)

    def half(self, size: int, suffix: bool) -> np.ndarray:
        """Hash of the first or last ``size`` letters, its side and size."""
        if suffix:
            lo = self.length - size
            raw = (self.exact[:, self.length] - self.exact[:, lo]) * self.down[lo]
            return mix(raw + np.uint64(size * _SUFFIX & _WORD))
        return mix(self.exact[:, size] + np.uint64(size * _PREFIX & _WORD))

    def keys(self, reduced: np.ndarray, length: int, half: np.ndarray) -> np.ndarray:
        """Join keys of reduced words (columns) that have ``length`` symbols, with one half of the word."""
        return mix(mix(reduced + np.uint64(length)) ^ half[:, None])

    def own(self) -> np.ndarray:
        """Keys under which the words are found: each half a neighbour may have left unchanged."""
        whole = self.reduced[:, self.length :]
        sizes = {self.length // 2, (self.length - 1) // 2}
        halves = [self.half(s, suffix) for s in sorted(sizes) for suffix in (False, True)]
        return np.concatenate([self.keys(whole, self.length, h) for h in halves], axis=1)

    def neighbours(self, lo: int, hi: int) -> np.ndarray:
        """Keys of all reduced words one edit away, for edits at the positions from lo to hi.

        The word itself counts as a change to an equal symbol.  Position ``length``
        only takes an insertion.
        """
        n, at = self.length, np.arange(lo, hi)
        end = self.reduced[:, n:]
        inside = at[at < n]
        before = self.reduced[:, inside]
        after = end - self.reduced[:, inside + 1]
        found = []
        for s in range(1, SYMBOLS + 1):
            put = np.uint64(s) * self.up[inside]
            found.append((inside, before + put + after, n, n // 2))
        shorter = before + after * np.uint64(_BACK)
        found.append((inside, shorter, n - 1, (n - 1) // 2))
        for s in range(1, SYMBOLS + 1):
            behind = (end - self.reduced[:, at]) * np.uint64(_BASE)
            found.append((at, self.reduced[:, at] + np.uint64(s) * self.up[at] + behind, n + 1, n // 2))
        out = []
        for place, reduced, length, size in found:
            # An edit before the last `size` letters leaves them; one after the first `size` leaves those.
            gone = 0 if length > n else 1
            keeps_suffix = place + gone <= n - size
            for suffix, keeps in ((True, keeps_suffix), (False, ~keeps_suffix)):
                if keeps.any():
                    out.append(self.keys(reduced[:, keeps], length, self.half(size, suffix)))
        return np.concatenate(out, axis=1)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, _Words, int]]:
    """(row numbers, words, edits at a time) for the words of a batch, a bounded number of letters at a time."""
    words = batch.column("word").to_pylist()
    lengths = np.array([len(w) for w in words], np.int64)
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        step = max(1, WRITTEN // ((2 * SYMBOLS + 1) * (length + 1)))
        for lo in range(0, len(rows), step):
            some = rows[lo : lo + step]
            yield some, _Words([words[i] for i in some], length), max(1, WRITTEN // ((2 * SYMBOLS + 1) * len(some)))


def _written(batch: pa.RecordBatch, rows: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    """The rows' words and counts under their keys, each key of a word once."""
    keys = np.sort(keys, axis=1)
    fresh = np.ones(keys.shape, bool)
    fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
    who = np.broadcast_to(rows[:, None], keys.shape)[fresh]
    taken = batch.take(pa.array(who))
    return pa.record_batch(
        [pa.array(keys[fresh].view(np.int64)), taken.column("word"), taken.column("n")], ["key", "word", "n"]
    )


def _own_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, words, _ in _by_length(batch):
            yield _written(batch, rows, words.own())


def _neighbour_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, words, step in _by_length(batch):
            for lo in range(0, words.length + 1, step):
                yield _written(batch, rows, words.neighbours(lo, min(words.length + 1, lo + step)))


def near_words(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: all ordered pairs of words exactly one edit apart."""
    schema = "key bigint, word string, n bigint"
    met = words.mapInArrow(_neighbour_keys, schema)
    found = words.mapInArrow(_own_keys, schema).select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    one_edit = (F.col("word") != F.col("near")) & (F.levenshtein("word", "near", 1) == 1)
    return met.join(found, "key").where(one_edit).select("word", "n", "near", "near_n").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """word and root of words with a form, by doubling the steps along the forms.

    A form has at least twice the occurrences of its word, so a chain of forms is no
    longer than the binary digits of a count, and six rounds end the longest.
    """
    steps = stage(forms.select("word", F.col("form").alias("root")), "spelling-steps")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stage(
            steps.join(onward, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            ),
            "spelling-steps",
        )
        steps = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return steps


def spelling_variants(docs: DataFrame, shortest: int = 5, least: int = 3, share: int = 2) -> DataFrame:
    """Columns word, form, root, n, n_near, form_n: one row per word of the corpus.

    Words are lower-cased (A-Z only) runs of Latin letters, one in 97 (doc_id, run)
    without one letter, with at least ``shortest`` letters and ``least`` occurrences.
    ``form`` is the word one edit away with most occurrences, at least ``share`` times
    those of the word; among equals the smallest.  ``root`` follows the forms to the
    last.  A null or empty text has no word, a null doc_id counts as the empty text in
    the checksum, repeated rows count again, a table without words gives no row, and
    other columns are ignored.  Runs jobs and stages tables.
    """
    if share < 2:
        raise ValueError("share must be at least 2, so that forms end")
    words = stage(vocabulary(docs, shortest, least), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    known = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    rows = words.join(known, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(-F.col("best.less") >= share * F.col("n"), F.col("best.form")).alias("form"),
        F.when(-F.col("best.less") >= share * F.col("n"), -F.col("best.less")).alias("form_n"),
    )
    rows = stage(rows, "spelling-forms")
    roots = _roots(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def variants_sql(shortest: int = 5, least: int = 3, share: int = 2) -> str:
    """DuckDB counterpart over ``documents``: pairs by all words without one letter."""
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH RECURSIVE {crc_table_sql()},
    r AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all({lowered}, '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
    g AS (SELECT d, w, count(*) AS k, any_value(crc_table) AS crc_table FROM r, crc GROUP BY d, w),
    h AS (SELECT w, k, {crc_sql("d || ':' || w")} AS h FROM g),
    a AS (SELECT CASE WHEN h % {DAMAGED} = 0 THEN left(w, (h % length(w))::BIGINT) || substr(w, (h % length(w) + 2)::BIGINT) ELSE w END AS word, k FROM h),
    v AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM a WHERE length(word) >= {shortest} GROUP BY word HAVING sum(k) >= {least}),
    s AS MATERIALIZED (SELECT word, n, p, left(word, p - 1) || substr(word, p + 1) AS rest FROM v, unnest(range(1, length(word) + 1)) AS u(p)),
    e AS (SELECT x.word, y.word AS near, y.n AS near_n FROM s x JOIN s y ON x.rest = y.rest AND x.p = y.p AND x.word <> y.word
      UNION SELECT s.word, v.word, v.n FROM s JOIN v ON v.word = s.rest
      UNION SELECT v.word, s.word, s.n FROM s JOIN v ON v.word = s.rest),
    b AS (SELECT word, count(*) AS n_near, min(struct_pack(l := -near_n, f := near)) AS best FROM e GROUP BY word),
    f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.l >= {share} * v.n THEN best.f END AS form,
            CASE WHEN -best.l >= {share} * v.n THEN -best.l END AS form_n FROM v LEFT JOIN b USING (word)),
    w AS (SELECT word, word AS at FROM f UNION ALL SELECT w.word, f.form FROM w JOIN f ON f.word = w.at WHERE f.form IS NOT NULL),
    o AS (SELECT w.word, w.at AS root FROM w JOIN f ON f.word = w.at WHERE f.form IS NULL)
    SELECT f.word, f.form, o.root, f.n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n FROM f JOIN o USING (word)"""
