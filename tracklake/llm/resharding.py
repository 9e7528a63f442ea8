"""Resharding that moves the fewest bytes: a minimum-cost flow from old shards to new capacities.

Law ``bytes``: the new shards get sizes as equal as whole rows allow. Old shard sizes are the supplies
and the new shards' equal parts the demands; a byte that stays costs nothing and one that moves costs 1. The
flow's graph has an edge from each old shard to the new one of its number and two to a hub that all moved bytes pass,
so it has as many edges as shards. It is solved on the driver from one number per shard.

A shard's surplus is cut from its small rows, so that a cut falls near its byte. Places in a shard are distributed
prefix sums over size classes and hash buckets. Each row's new shard and slot follow from two small joins, and the
text is shuffled once, into new files. Shards whose rows don't change are not written again where the old files are named.

Defined cases: a null text has no bytes and size 1; rows that are equal in id and text stay together; null ids are
rows like others; an empty table gives empty shards; a row larger than a shard's part makes that shard larger; columns
whose names clash with shard or slot are kept in a struct in the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import drop_written, new_path, prefix_sums, written

#: Rows of a bucket at most, about, in prefix sums.
BUCKET_ROWS = 20_000


def minimum_cost_flow(edges: list[tuple[int, int, int, int]], source: int, sink: int, nodes: int) -> list[int]:
    """Flow on each edge (from, to, capacity, cost) of a maximum flow of least cost, by successive shortest paths."""
    graph: list[list[int]] = [[] for _ in range(nodes)]
    to, room, cost = [], [], []
    for a, b, capacity, price in edges:
        graph[a].append(len(to))
        graph[b].append(len(to) + 1)
        to += [b, a]
        room += [capacity, 0]
        cost += [price, -price]
    while True:
        far: list[float] = [float("inf")] * nodes
        far[source], came, queue, waiting = 0, [-1] * nodes, [source], {source}
        while queue:
            a = queue.pop(0)
            waiting.discard(a)
            for e in graph[a]:
                if room[e] and far[a] + cost[e] < far[to[e]]:
                    far[to[e]], came[to[e]] = far[a] + cost[e], e
                    if to[e] not in waiting:
                        waiting.add(to[e])
                        queue.append(to[e])
        if came[sink] < 0:
            return [room[2 * i + 1] for i in range(len(edges))]
        path, at = [], sink
        while at != source:
            path.append(came[at])
            at = to[came[at] ^ 1]
        most = min(room[e] for e in path)
        for e in path:
            room[e] -= most
            room[e ^ 1] += most


def transfers(old: dict[int, int], shards: int) -> list[tuple[int, int, int]]:
    """Blocks (old shard, new shard, bytes) that make ``shards`` equal sizes; what stays is last of each old shard."""
    names, total = sorted(old), sum(old.values())
    part = [total * (j + 1) // shards - total * j // shards for j in range(shards)]
    source, sink, hub, first = 0, 1, 2, 3
    news = first + len(names)
    edges = [(source, first + i, old[k], 0) for i, k in enumerate(names)]
    edges += [(news + j, sink, part[j], 0) for j in range(shards)]
    stay = [(first + i, news + k, old[k], 0) for i, k in enumerate(names) if k < shards]
    out = [(first + i, hub, old[k], 1) for i, k in enumerate(names)]
    into = [(hub, news + j, part[j], 0) for j in range(shards)]
    flow = minimum_cost_flow([*edges, *stay, *out, *into], source, sink, news + shards)[len(edges) :]
    kept, left, gaps = flow[: len(stay)], flow[len(stay) : len(stay) + len(out)], flow[len(stay) + len(out) :]
    moves: list[tuple[int, int, int]] = []
    j = 0
    for i, k in enumerate(names):
        while left[i]:
            while not gaps[j]:
                j += 1
            most = min(left[i], gaps[j])
            moves.append((k, j, most))
            left[i] -= most
            gaps[j] -= most
        moves += [(k, k, f) for (a, _, _, _), f in zip(stay, kept, strict=True) if a == first + i and f]
    return moves


def assign(units: DataFrame, shards: int) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """``units`` (key, old, bytes, rows) with ``shard`` and the first ``slot`` of each unit; and the transfers."""
    spark = units.sparkSession
    sums = units.groupBy("old").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).collect()
    sizes, n = {r.old: r["bytes"] for r in sums}, sum(r["rows"] for r in sums)
    moves = transfers(sizes, shards) if sizes else []
    at: dict[int, int] = {}
    pieces = []
    for old, new, size in moves:
        low = at.get(old, 0)
        at[old] = low + size
        pieces.append((old, new, 2 * low, 2 * at[old] if at[old] < sizes[old] else 1 << 62))
    # one row per transfer, at most twice as many as shards
    table = F.broadcast(spark.createDataFrame(pieces, "old int, shard int, low long, high long"))
    parts = max(1, -(-n // BUCKET_ROWS))
    hashed = units.withColumns({"class": F.floor(F.log2("bytes")).cast("int"), "h": F.xxhash64("key", F.lit(8))})
    hashed = hashed.withColumn("part", F.pmod(F.shiftrightunsigned("h", 20), F.lit(parts)).cast("int"))
    placed = prefix_sums(hashed, ["old"], ["class", "part"], ["h", "key"], {"begin": "bytes"})
    placed = placed.withColumn("middle", 2 * F.col("begin") + F.col("bytes"))
    placed = placed.join(table, "old").where("middle >= low and middle < high").drop("low", "high", "middle", "begin", "class")
    slots = prefix_sums(placed, ["shard"], ["part"], ["h", "key"], {"slot": "rows"})
    return slots.select("key", "shard", "slot"), moves


def reshard(docs: DataFrame, old_shard: F.Column, path: str, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", old_path: str | None = None) -> DataFrame:
    """Write ``docs`` to Parquet files under ``path``, by ``shard`` with a gapless ``slot``; return them read again.

    The files hold (row struct of the columns, slot). ``old_shard`` tells where each row lies now. With ``old_path``, the
    folder of an earlier call, shards that no transfer touches are left there and only read from it.
    """
    spark = docs.sparkSession
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    text = F.col(text_col).cast("string")
    keyed = docs.select(row, F.xxhash64(F.col(id_col), text).alias("key"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"), old_shard.cast("int").alias("old"))
    units = written(keyed.groupBy("key").agg(F.min("old").alias("old"), F.sum("size").alias("bytes"), F.count("*").alias("rows")), "units")
    where, moves = assign(units, shards)
    where = written(where, "assignment")
    rows = keyed.select("row", "key").join(where, "key")
    again = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    rows = rows.withColumn("slot", F.col("slot") + again - 1).select("row", "shard", "slot")
    touched = {x for old, new, _ in moves if old != new for x in (old, new)}
    untouched = sorted({new for _, new, _ in moves} - touched) if old_path else []
    if untouched:
        rows = rows.where(~F.col("shard").isin(untouched))
    rows.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    drop_written(units, where)
    schema = rows.select("row", "slot").schema.add("shard", T.IntegerType())
    out = spark.read.schema(schema).parquet(path)
    if untouched:
        out = out.unionByName(spark.read.schema(schema).parquet(old_path).where(F.col("shard").isin(untouched)))
    return out


def old_layout(column: str = "source", shards: int = 12) -> F.Column:
    """The layout before: rows by a hash of a column, so that a common value makes a large shard."""
    return F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(shards)).cast("int")


def op8_resharding(spark, sf_dir):
    """All documents moved from 12 shards by source into 16 of near equal bytes, read from the new files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = reshard(docs.select("doc_id", "text", "source"), old_layout(), new_path(spark, "shards"))
    data = F.coalesce(F.encode(F.col("row.text"), "utf-8"), F.lit(b""))
    return out.select("row.doc_id", (F.length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op8_resharding": op8_resharding}
SQL = {}
