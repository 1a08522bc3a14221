"""Prefix trie of conversations by a splitter skeleton.

Every conversation becomes one path: 16 bytes of digest a turn.  Paths are cut
into ranges at splitters, so a range holds one run of the sorted paths, and:

1. a node that no splitter path goes through has all its members in one range.
   One pass over the sorted range finishes it, holding only the nodes of the
   current path;
2. the nodes on splitter paths (the skeleton, broadcast: at most one path per
   range) leave one partial row per range, which a grouping reduces;
3. sums over the subtrees of the skeleton are differences of running sums in the
   order of its nodes, which the broadcast skeleton numbers.

Splitters are cut to the shortest path that tells their neighbours apart.  Equal
paths are told apart by conv_id, so a path that very many conversations share is
spread over many ranges.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainrisk.llm.hashing import crc_sql, crc_table_sql
from chainrisk.sources.staging import stage

TURN_BYTES = 16
#: Conversations sampled per range to place the splitters.
SAMPLES_A_RANGE = 16
#: Finished children that a node holds back until its smallest member is known.
HELD_CHILDREN = 1 << 12
#: Ids in one piece of a skeleton node's list of ends.
ENDS_IN_PIECE = 1 << 13
ROWS_IN_BATCH = 1 << 12
ROOT = hashlib.md5(b"").digest()
NODE = {
    "kind": pa.int32(), "id": pa.binary(), "parent": pa.binary(), "pre": pa.int64(), "last": pa.int64(),
    "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(),
    "n_children": pa.int64(), "n_leaves": pa.int64(), "saved": pa.int64(), "size": pa.int64(), "ends": pa.binary(),
}
FINISHED, PARENT_OPEN, PARTIAL, ENDS, PARENT = range(5)
LEAST = -(1 << 63)


def node_below(node: bytes, turn: bytes) -> bytes:
    return hashlib.md5(node + turn).digest()


def turns_of(path: bytes) -> list[bytes]:
    return [path[i : i + TURN_BYTES] for i in range(0, len(path), TURN_BYTES)]


def shared_turns(a: bytes, b: bytes) -> int:
    """Leading turns that two paths have in common."""
    high = min(len(a), len(b)) // TURN_BYTES
    if a[: high * TURN_BYTES] == b[: high * TURN_BYTES]:
        return high
    low = 0
    while high - low > 1:
        middle = (low + high) // 2
        if a[: middle * TURN_BYTES] == b[: middle * TURN_BYTES]:
            low = middle
        else:
            high = middle
    return low


def rebuilt_paths(conversations: DataFrame) -> DataFrame:
    """conv_id, path and sizes (bytes of text a turn) of every rebuilt conversation.

    One shuffle: the conversations that share a beginning share a partition.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(
            F.col("turn").alias("turn"), role.alias("role"), F.unhex(F.md5(text)).alias("body"),
            F.octet_length(text).cast("bigint").alias("size"),
        ).alias("t"),
    )
    base = (F.col("conv_id") - F.col("conv_id") % 5).alias("base")
    own = turns.select(base, "conv_id", "t").repartition("base").groupBy("base", "conv_id")
    digest = lambda t: F.md5(
        F.concat(F.octet_length(t["role"]).cast("string"), F.lit(":"), t["role"], F.lit(":"), F.hex(t["body"]))
    )
    sorted_turns = F.transform(
        F.sort_array(F.collect_list("t")), lambda t: F.struct(digest(t).alias("digest"), t["size"].alias("size"))
    )
    own = own.agg(sorted_turns.alias("turns"))
    first = F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, 8))
    shared = F.first(first, ignorenulls=True).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    whole = own.withColumn("head", F.coalesce(shared, F.slice("turns", 1, 0))).withColumn("h", h)
    kept = F.concat(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns")))
    rows = whole.select("conv_id", kept.alias("turns"))
    path = F.unhex(F.array_join(F.col("turns.digest"), ""))
    return rows.select("conv_id", path.alias("path"), F.col("turns.size").alias("sizes"))


def splitters(paths: DataFrame, ranges: int) -> list[tuple[bytes, int]]:
    """At most ``ranges`` - 1 sorted (path, conv_id) that cut the turns into about equal ranges.

    From a sample by hash of about SAMPLES_A_RANGE conversations a range, all that
    reaches the driver.
    """
    one_in = max(1, paths.count() // (SAMPLES_A_RANGE * ranges))
    taken = paths.where(F.pmod(F.xxhash64("conv_id"), F.lit(one_in)) == 0).select("path", "conv_id").collect()
    rows = sorted((bytes(r.path), r.conv_id) for r in taken)
    share = sum(len(p) + TURN_BYTES for p, _ in rows) / ranges
    cuts, filled = [], 0
    for (before, _), (path, conv) in zip(rows, rows[1:]):
        filled += len(before) + TURN_BYTES
        if filled < share * (len(cuts) + 1):
            continue
        cuts.append((path, conv) if path == before else (path[: (shared_turns(before, path) + 1) * TURN_BYTES], LEAST))
    return cuts


def skeleton_of(cuts: list[tuple[bytes, int]]) -> dict[bytes, tuple[int, int]]:
    """Nodes on the splitter paths: their number in sorted order and the last number below them."""
    numbers, last, stack, before = {ROOT: 0}, {ROOT: 0}, [ROOT], b""
    for path, _ in cuts:
        del stack[shared_turns(before, path) + 1 :]
        for turn in turns_of(path)[len(stack) - 1 :]:
            stack.append(node_below(stack[-1], turn))
            numbers[stack[-1]] = len(numbers)
        for node in stack:
            last[node] = len(numbers) - 1
        before = path
    return {node: (number, last[node]) for node, number in numbers.items()}


def _with_range(batches: Iterable[pa.RecordBatch], cuts: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist())
        where = pa.array([bisect_right(cuts.value, key) for key in keys], pa.int32())
        yield pa.record_batch([*batch.columns, where], [*batch.schema.names, "part"])


class _Node:
    __slots__ = ("id", "size", "low", "convs", "children", "leaves", "saved", "ends", "held", "place", "late")

    def __init__(self, node: bytes, size: int, place: tuple[int, int] | None) -> None:
        self.id, self.size, self.place = node, size, place
        self.low: int | None = None
        self.convs = self.children = self.leaves = self.saved = 0
        self.ends = None if place is None else []
        self.held: list[dict] = []
        self.late = False


class _Range:
    """One pass over the sorted conversations of a range; ``out`` collects rows of NODE."""

    def __init__(self, skeleton: dict[bytes, tuple[int, int]]) -> None:
        self.skeleton = skeleton
        self.out: list[dict] = []
        self.stack = [_Node(ROOT, 0, skeleton[ROOT])]
        self.path = b""

    def add(self, conv: int, path: bytes, sizes: list[int]) -> None:
        self._close(shared_turns(self.path, path))
        for depth in range(len(self.stack) - 1, len(path) // TURN_BYTES):
            turn = path[depth * TURN_BYTES : (depth + 1) * TURN_BYTES]
            node = node_below(self.stack[-1].id, turn)
            self.stack.append(_Node(node, sizes[depth], self.skeleton.get(node)))
        self.path = path
        top = self.stack[-1]
        top.convs += 1
        if top.low is None or conv < top.low:
            top.low = conv
        if top.place is not None:
            top.ends.append(conv)
            if len(top.ends) >= ENDS_IN_PIECE:
                self._write_ends(top)
        elif top.ends is None:
            top.ends = hashlib.sha256(b"%d" % conv)
        else:
            top.ends.update(b",%d" % conv)

    def finish(self) -> None:
        self._close(0)
        if self.stack[0].convs:
            self._partial(self.stack[0], None, 0)

    def _close(self, depth: int) -> None:
        while len(self.stack) > depth + 1:
            node = self.stack.pop()
            above = self.stack[-1]
            above.convs += node.convs
            above.low = node.low if above.low is None else min(above.low, node.low)
            if node.place is not None:
                self._partial(node, above.id, len(self.stack))
            else:
                self._finished(node, above, len(self.stack))

    def _write_ends(self, node: _Node) -> None:
        if node.ends:
            self.out.append({"kind": ENDS, "id": node.id, "conv_id": node.ends[0], "ends": b",".join(b"%d" % c for c in node.ends)})
            node.ends = []

    def _partial(self, node: _Node, parent: bytes | None, depth: int) -> None:
        self._write_ends(node)
        self.out.append(
            {
                "kind": PARTIAL, "id": node.id, "parent": parent, "pre": node.place[0], "last": node.place[1],
                "conv_id": node.low, "depth": depth, "n_convs": node.convs, "n_children": node.children,
                "n_leaves": node.leaves, "saved": node.saved, "size": node.size,
            }
        )

    def _finished(self, node: _Node, above: _Node, depth: int) -> None:
        for row in node.held:
            row["parent_conv_id"] = node.low
        self.out += node.held
        if node.late:
            self.out.append({"kind": PARENT, "id": node.id, "conv_id": node.low})
        leaves = node.leaves if node.children else 1
        saved = node.saved + (node.convs - 1) * node.size
        ends = (node.ends or hashlib.sha256()).hexdigest().encode()
        row = {
            "kind": FINISHED, "conv_id": node.low, "depth": depth, "n_convs": node.convs,
            "n_children": node.children, "n_leaves": leaves, "saved": saved, "ends": ends,
        }
        above.children += 1
        above.leaves += leaves
        above.saved += saved
        above.held.append(row)
        if above.place is not None or len(above.held) >= HELD_CHILDREN:
            for row in above.held:
                row.update(kind=PARENT_OPEN, parent=above.id)
            self.out += above.held
            above.late = True
            above.held = []


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r.get(c) for r in rows], kind) for c, kind in NODE.items()], list(NODE))


def _nodes(batches: Iterable[pa.RecordBatch], skeleton: Broadcast) -> Iterator[pa.RecordBatch]:
    work, part = _Range(skeleton.value), None
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            piece = batch.slice(lo, 1024)
            for where, conv, path, sizes in zip(
                *(piece.column(c).to_pylist() for c in ("part", "conv_id", "path", "sizes"))
            ):
                if part is not None and where != part:
                    work.finish()
                    fresh = _Range(skeleton.value)
                    fresh.out, work = work.out, fresh
                part = where
                work.add(conv, path, sizes)
                if len(work.out) >= ROWS_IN_BATCH:
                    yield _batch(work.out)
                    work.out = []
    work.finish()
    if work.out:
        yield _batch(work.out)


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's list of ends, from its pieces in order."""
    current, state = None, None

    def done() -> pa.RecordBatch:
        return pa.record_batch([pa.array([current], pa.binary()), pa.array([state.hexdigest()])], ["id", "ends_sha256"])

    for batch in batches:
        for node, ends in zip(batch.column("id"), batch.column("ends")):
            node, ends = node.as_py(), ends.as_py()
            if node == current:
                state.update(b"," + ends)
                continue
            if current is not None:
                yield done()
            current, state = node, hashlib.sha256(ends)
    if current is not None:
        yield done()


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """All nodes of the trie of rebuilt conversations, one row a node.

    Columns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.  A conversation is rebuilt from the first h
    turns of conversation c - c % 5 and its own turns after its first h, with
    h = crc32 of c's digits % 9; the remainder of a negative c is negative, as in SQL.
    Turns go by number, null first; turns with the same
    number by role, then by the md5 of their text, and repeated rows are turns of their
    own.  A null role or text is empty.  Rows without conv_id take no part; without any
    conversation there is no node, not even the root.  Other columns are ignored.

    A conversation's digests travel as one value, 16 bytes a turn; texts do not travel.
    Runs jobs and stages tables.
    """
    spark = conversations.sparkSession
    paths = stage(rebuilt_paths(conversations), "trie-paths")
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = splitters(paths, ranges)
    cut_paths, skeleton = (spark.sparkContext.broadcast(x) for x in (cuts, skeleton_of(cuts)))
    dealt = paths.mapInArrow(
        lambda it: _with_range(it, cut_paths), "conv_id bigint, path binary, sizes array<bigint>, part int"
    ).repartitionById(ranges, "part")
    kinds = {pa.int32(): "int", pa.int64(): "bigint", pa.binary(): "binary"}
    schema = ", ".join(f"{c} {kinds[kind]}" for c, kind in NODE.items())
    ordered = dealt.sortWithinPartitions("part", "path", "conv_id")
    found = stage(ordered.mapInArrow(lambda it: _nodes(it, skeleton), schema), "trie-nodes")
    for sent in (cut_paths, skeleton):
        sent.unpersist()
    of = lambda kind: found.where(F.col("kind") == kind)

    # The skeleton: partial rows of the ranges, children and sums over subtrees.
    part = of(PARTIAL).groupBy("id", "parent", "pre", "last", "depth", "size")
    sums = part.agg(
        F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved"))
    )
    below = sums.groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("more"))
    children = F.col("n_children") + F.coalesce("more", F.lit(0))
    own = sums.join(below, "id", "left").withColumn("n_children", children)
    own = own.withColumn("own_leaves", F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0))
    own = own.withColumn("own_saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("size"))
    upto = Window.orderBy("pre")
    for c in ("leaves", "saved"):
        own = own.withColumn(f"upto_{c}", F.sum(f"own_{c}").over(upto))
    own = stage(own, "trie-skeleton")
    ends_of = own.select(F.col("pre").alias("last"), *(F.col(f"upto_{c}").alias(f"last_{c}") for c in ("leaves", "saved")))
    heads = own.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    pieces = of(ENDS).select("id", "conv_id", "ends").repartition("id").sortWithinPartitions("id", "conv_id")
    hashed = pieces.mapInArrow(_digests, "id binary, ends_sha256 string")
    total = lambda c: F.col(f"last_{c}") - F.col(f"upto_{c}") + F.col(f"own_{c}")
    skeleton_rows = (
        own.join(ends_of, "last").join(heads, "parent", "left").join(hashed, "id", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", total("leaves").alias("n_leaves"),
            total("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )

    # All other nodes; children of the skeleton and of very wide nodes look their parent up.
    known = heads.unionByName(of(PARENT).select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id")))
    columns = [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.col("ends").cast("string").alias("ends_sha256"),
    ]
    finished = of(FINISHED).select(*columns)
    open_rows = of(PARENT_OPEN).drop("parent_conv_id").join(known, "parent").select(*columns)
    return finished.unionByName(open_rows).unionByName(skeleton_rows)


def trie_sql() -> str:
    """DuckDB counterpart over ``conversations``."""
    return f"""
    WITH {crc_table_sql()},
    t AS (SELECT conv_id, coalesce(role, '') AS r, octet_length(encode(coalesce(text, ''))) AS b, md5(coalesce(text, '')) AS m,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS k
          FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, {crc_sql('conv_id::VARCHAR')} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t), crc),
    r AS (SELECT c.conv_id, t.k, t.b, md5(strlen(t.r) || ':' || t.r || t.m) AS e FROM c JOIN t
            ON (t.conv_id = c.conv_id - c.conv_id % 5 AND t.k <= c.h) UNION ALL
          SELECT c.conv_id, t.k, t.b, md5(strlen(t.r) || ':' || t.r || t.m) FROM c JOIN t ON t.conv_id = c.conv_id AND t.k > c.h),
    p AS (SELECT c.conv_id, coalesce(list(r.e ORDER BY r.k) FILTER (r.k IS NOT NULL), []) AS path,
            coalesce(list(r.b ORDER BY r.k) FILTER (r.k IS NOT NULL), []) AS sizes FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
    m AS (SELECT conv_id, d, array_to_string(path[1:d], '') AS node, array_to_string(path[1:d - 1], '') AS above,
            CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size, d = len(path) AS stops FROM p, unnest(range(len(path) + 1)) AS u(d)),
    n AS (SELECT node, d, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
            sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (stops), '')) AS ends_sha256 FROM m GROUP BY node, d),
    k AS (SELECT above AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY above),
    f AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k USING (node)),
    s AS (SELECT left(f.node, 32 * a.d) AS node, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
            sum((f.n_convs - 1) * f.size) AS saved_tokens FROM f, unnest(range(f.d + 1)) AS a(d) GROUP BY 1)
    SELECT f.conv_id, f.d AS depth, CASE WHEN f.d > 0 THEN g.conv_id END AS parent_conv_id, f.n_convs, f.n_children::BIGINT AS n_children,
      s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
    FROM f JOIN s USING (node) LEFT JOIN n g ON g.node = f.above AND g.d = f.d - 1"""
