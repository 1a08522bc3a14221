"""How often 64-bit hashes occur in a whole corpus, as a table of bounded size.

Every occurrence is counted, after hashes have been scattered, so that callers may
pass hashes of any range.  What leaves the count is one of four levels per slot (the
top bits of a hash; the highest level of the slot's hashes).  Slots follow the size
of the input, up to 64 MB of them.  A shared slot can only raise a level: level 0
proves that a hash occurs once, and any order by level is the same for all documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from chainrisk.llm.arrays import mix, split_by_bucket

#: Least and most bits of a slot number; two bits a slot.
LEAST_SLOTS, MOST_SLOTS = 22, 28
#: Bytes of input a slot and a bucket stand for.
SLOT_BYTES, BUCKET_BYTES = 4, 1 << 22
FLUSH = 1 << 20


def _input_bytes(df: DataFrame) -> int:
    """The planner's size of a frame: the bytes of its files, or an estimate."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def slot_bits(size: int) -> int:
    return min(MOST_SLOTS, max(LEAST_SLOTS, (size // SLOT_BYTES).bit_length()))


def bucket_bits(df: DataFrame) -> int:
    """Bits of the bucket number: at least 256 buckets, over four per shuffle partition, and by input size."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(20, max(8, (4 * partitions - 1).bit_length(), (_input_bytes(df) // BUCKET_BYTES).bit_length()))


def _packed(
    batches: Iterable[pa.RecordBatch],
    hashes_of: Callable[[Iterable[pa.RecordBatch]], Iterator[np.ndarray]],
    bits: int,
) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        h, counts = np.unique(mix(np.concatenate(held)), return_counts=True)
        held.clear()
        part = (h << np.uint64(bits) >> np.uint64(32)).astype(np.uint32)
        found = list(split_by_bucket(h, bits))
        # Counts above one go with the place of their hash.
        more = [np.flatnonzero(counts[s] > 1).astype(np.uint32) for _, s in found]
        times = [counts[s][at].astype(np.uint32) for (_, s), at in zip(found, more)]
        columns = [[part[s].tobytes() for _, s in found], *([x.tobytes() for x in c] for c in (more, times))]
        return pa.record_batch(
            [pa.array([b for b, _ in found], pa.int32()), *(pa.array(c, pa.binary()) for c in columns)],
            ["bucket", "hashes", "more", "times"],
        )

    size = 0
    for h in hashes_of(batches):
        held.append(h)
        size += len(h)
        if size >= FLUSH:
            yield flush()
            size = 0
    if size:
        yield flush()


def _levels_of(pdf: pd.DataFrame, bits: int, slots: int, steps: tuple[int, int, int]) -> pd.DataFrame:
    parts, weights = [], []
    for hashes, more, times in zip(pdf["hashes"], pdf["more"], pdf["times"]):
        parts.append(np.frombuffer(hashes, np.uint32))
        weights.append(np.ones(len(parts[-1]), np.int64))
        weights[-1][np.frombuffer(more, np.uint32)] = np.frombuffer(times, np.uint32)
    found = np.concatenate(parts)
    order = np.argsort(found)
    found = found[order]
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    counts = np.add.reduceat(np.concatenate(weights)[order], first)
    slot = found[first] >> np.uint32(32 - (slots - bits))
    table = np.zeros(1 << (slots - bits), dtype=np.uint8)
    for level, least in enumerate(steps, start=1):
        table[slot[counts >= least]] = level
    quads = table.reshape(-1, 4)
    packed = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "levels": [packed.tobytes()]})


def corpus_levels(
    df: DataFrame,
    hashes_of: Callable[[Iterable[pa.RecordBatch]], Iterator[np.ndarray]],
    steps: tuple[int, int, int],
) -> Broadcast:
    """Broadcast level table of all hashes that ``hashes_of`` draws from the rows of ``df``.

    ``steps`` are the least counts of levels 1 to 3.
    """
    spark = df.sparkSession
    bits = bucket_bits(df)
    slots = max(slot_bits(_input_bytes(df)), bits + 2)
    packed = df.mapInArrow(lambda it: _packed(it, hashes_of, bits), "bucket int, hashes binary, more binary, times binary")
    counted = packed.groupBy("bucket").applyInPandas(
        lambda pdf: _levels_of(pdf, bits, slots, steps), "bucket int, levels binary"
    )
    table = np.zeros(1 << (slots - 2), dtype=np.uint8)
    width = len(table) >> bits
    for row in counted.collect():
        table[row.bucket * width : (row.bucket + 1) * width] = np.frombuffer(row.levels, np.uint8)
    return spark.sparkContext.broadcast(table)


def level_of(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Levels (0 to 3) of hashes as uint64."""
    slots = len(table).bit_length() + 1
    slot = mix(hashes) >> np.uint64(64 - slots)
    return (table[slot >> np.uint64(2)] >> (slot & np.uint64(3)).astype(np.uint8) * 2 & 3).astype(np.uint64)
