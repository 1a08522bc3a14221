"""Sharding by a hierarchical weighted hash tree, in built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainrisk.llm.hashing import draw, draw_sql, text_key
from chainrisk.sources.staging import stage

#: A layout: regions of racks of (shard, weight) pairs.
Layout = list[list[list[tuple[int, float]]]]


def layout(weights: Sequence[float], rack_size: int = 4, region_size: int = 8) -> Layout:
    """Shards in their order, ``rack_size`` to a rack and ``region_size`` to a region."""
    shards = list(enumerate(map(float, weights)))
    regions = [shards[i : i + region_size] for i in range(0, len(shards), region_size)]
    return [[r[i : i + rack_size] for i in range(0, len(r), rack_size)] for r in regions]


def _weight(node: object) -> float:
    return node[1] if isinstance(node, tuple) else sum(map(_weight, node))


def _nodes(children: list[tuple[str, float, int]]) -> Column:
    return F.array(
        *(F.struct(F.lit(p).alias("path"), F.lit(w).alias("weight"), F.lit(i).alias("id")) for p, w, i in children)
    )


def _drawn(children: Column, key: Column) -> Column:
    """Id of the child with the least exponential draw over its weight.

    A child's draw depends on the key and the child's path alone, so a changed weight
    moves rows to or from that child only.
    """
    scored = F.transform(
        children, lambda c: F.struct((-F.log(draw(key, c["path"])) / c["weight"]).alias("s"), c["id"].alias("i"))
    )
    return F.array_min(scored)["i"]


def with_shard(df: DataFrame, tree: Layout, key: str, name: str) -> DataFrame:
    """``df`` with the shard of its text key: draws a region, then a rack of it, then a shard of that."""
    racks, shards, regions = [], [], []
    for i, region in enumerate(tree):
        regions.append((f"/{i}", _weight(region), i))
        of_region = []
        for j, rack in enumerate(region):
            of_region.append((f"/{i}/{j}", _weight(rack), len(shards)))
            shards.append(_nodes([(f"/{i}/{j}/{k}", w, n) for k, (n, w) in enumerate(rack)]))
        racks.append(_nodes(of_region))
    k = F.col(key)
    return (
        df.withColumn("t_region", _drawn(_nodes(regions), k))
        .withColumn("t_rack", _drawn(F.get(F.array(*racks), F.col("t_region")), k))
        .withColumn(name, _drawn(F.get(F.array(*shards), F.col("t_rack")), k))
        .drop("t_region", "t_rack")
    )


def tree_shards(
    docs: DataFrame, weights: Sequence[float] = (1.0,) * 16, grown: Sequence[float] | None = (1.0,) * 17
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    ``size`` is the number of UTF-8 bytes of the text and 1 (a null text has none).
    Region, rack and shard are drawn by doc_id (null: the empty text) and their weights;
    ``grown`` gives the weights after growth.  A shard that opens a region of its own
    takes rows only into itself; one that joins a region also moves rows within it.
    ``slot`` counts the rows of a shard from 0 without gaps, in the order of a digest of
    doc_id, checksum and size.  Equal rows get slots side by side.

    Ranks come from counts per digest range, so no shard is gathered in one task.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(
        "doc_id",
        text_key("doc_id").alias("key"),
        (F.octet_length(body) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(body, "utf-8")).alias("text_crc32"),
    )
    rank_key = F.md5(F.concat_ws("|", "key", F.col("text_crc32").cast("string"), F.col("size").cast("string")))
    drawn = with_shard(base.withColumn("rank_key", rank_key), layout(weights), "key", "shard")
    if grown is None:
        drawn = drawn.withColumn("grown_shard", F.lit(None).cast("int"))
    else:
        drawn = with_shard(drawn, layout(grown), "key", "grown_shard")
    buckets = 4 * max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    part = (F.conv(F.substring("rank_key", 1, 8), 16, 10).cast("bigint") * buckets / (1 << 32)).cast("int")
    rows = stage(drawn.withColumn("part", part), "drawn")
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(
        counts.select("shard", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "starts"
    )
    within = Window.partitionBy("shard", "part").orderBy("rank_key", "doc_id")
    return (
        rows.withColumn("rank", F.row_number().over(within))
        .join(starts, ["shard", "part"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("before") + F.col("rank") - 1).alias("slot"),
            "grown_shard",
        )
    )


def _descend_sql(node: list, path: str) -> str:
    names = [f"{path}/{i}" for i in range(len(node))]
    below = [str(c[0]) if isinstance(c, tuple) else _descend_sql(c, name) for c, name in zip(node, names)]
    if len(node) == 1:
        return below[0]
    score = lambda c, name: f"-ln({draw_sql('key', f'{chr(39)}{name}{chr(39)}')}) / {_weight(c)!r}"
    scores = ", ".join(score(c, name) for c, name in zip(node, names))
    cases = " ".join(f"WHEN {i + 1} THEN {b}" for i, b in enumerate(below))
    return f"CASE list_position([{scores}], list_min([{scores}])) {cases} END"


def tree_sql(relation: str = "documents", weights: Sequence[float] = (1.0,) * 16, grown: Sequence[float] = (1.0,) * 17) -> str:
    """DuckDB counterpart of ``tree_shards``; the checksum runs over the bytes with a table made by its rule."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    table = "i::BIGINT"
    for _ in range(8):
        table = f"(SELECT {step} FROM (SELECT {table} AS c))"
    crc = (
        "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(body)::BIGINT), "
        "lambda i: ('0x' || substr(hex_text, (2 * i + 1)::BIGINT, 2))::BIGINT)), "
        "lambda a, b: xor(a >> 8, crc_table[(xor(a, b) & 255) + 1])), 4294967295)"
    )
    return f"""
    WITH steps AS (SELECT i, {table} AS entry FROM range(256) AS s(i)),
    entries AS (SELECT list(entry ORDER BY i) AS crc_table FROM steps),
    t AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, encode(coalesce(text, '')) AS body,
                 hex(encode(coalesce(text, ''))) AS hex_text, crc_table FROM {relation}, entries),
    c AS (SELECT doc_id, key, octet_length(body)::BIGINT + 1 AS size, {crc}::BIGINT AS text_crc32 FROM t),
    d AS (SELECT *, md5(concat_ws('|', key, text_crc32::VARCHAR, size::VARCHAR)) AS rank_key,
                 ({_descend_sql(layout(weights), "")})::INTEGER AS shard,
                 ({_descend_sql(layout(grown), "")})::INTEGER AS grown_shard FROM c)
    SELECT doc_id, size, text_crc32, 'key' AS law, shard,
           (row_number() OVER (PARTITION BY shard ORDER BY rank_key, doc_id) - 1)::BIGINT AS slot, grown_shard
    FROM d"""
