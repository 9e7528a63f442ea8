"""Mixing sources to target weights over a tree of domains, languages and sources.

The tree's weights split the token budget from the root down. A leaf can give its tokens times ``epochs``; where a node's
subtree can't use its part, the rest goes to its siblings in proportion to their weights, again until none is short, and only
what a whole family can't use goes back to its parent and the parent's siblings. The tree has one row per leaf on the driver,
checked against ``MOST_LEAVES``; documents never leave the executors.

A leaf's rows are put in a seeded order of their own for each epoch, epochs one after the other, and the prefix of tokens up to
the leaf's budget is taken: all of a row that ends within it, and of the row that crosses it the first ``tokens_used`` tokens.
Prefix sums go by hash buckets of bounded size, so that a leaf with a third of all rows divides over tasks. Whole epochs need no order: only
the last, partial one of a leaf is sorted.

Defined cases: null values in the tree's columns are a value of their own; null and empty texts have no tokens and are taken
with every full epoch, never in the partial one; repeated rows count each; weights of 0 take nothing and missing weights are 1; an empty table gives no rows; other columns are kept in a
struct.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import prefix_sums, written

MOST_LEAVES = 1_000_000
BUCKET_ROWS = 20_000


def budgets(supply: dict[tuple, int], weights: dict[tuple, float], total: int, epochs: int) -> dict[tuple, int]:
    """Tokens of each leaf (a path in the tree) of a budget ``total``.

    ``weights`` has the weight of any node by its path; the others have 1.
    """
    room: dict[tuple, int] = {}
    children: dict[tuple, set[tuple]] = {}
    for leaf, tokens in supply.items():
        for depth in range(len(leaf) + 1):
            room[leaf[:depth]] = room.get(leaf[:depth], 0) + tokens * epochs
            if depth:
                children.setdefault(leaf[: depth - 1], set()).add(leaf[:depth])
    out = dict.fromkeys(supply, 0)

    def usable(node: tuple) -> int:
        """What a node can use: nodes of weight 0 below it take nothing."""
        if node not in children:
            return room[node]
        return sum(usable(c) for c in children[node] if weights.get(c, 1.0) > 0)

    def give(node: tuple, amount: int) -> None:
        if node not in children:
            out[node] = amount
            return
        open_ = sorted((c for c in children[node] if weights.get(c, 1.0) > 0), key=repr)
        most = {c: usable(c) for c in open_}
        got = dict.fromkeys(open_, 0)
        left = min(amount, sum(most.values()))
        while left and open_:
            scale = sum(weights.get(c, 1.0) for c in open_)
            fair = {c: left * weights.get(c, 1.0) / scale for c in open_}
            short = [c for c in open_ if fair[c] >= most[c]]
            if short:
                for c in short:
                    got[c] = most[c]
                    left -= most[c]
                open_ = [c for c in open_ if c not in short]
                continue
            for c in open_:
                got[c] = math.floor(fair[c])
            rest = left - sum(got[c] for c in open_)
            for c in sorted(open_, key=lambda c: (got[c] - fair[c], repr(c)))[:rest]:
                got[c] += 1
            break
        for c, n in got.items():
            give(c, n)

    if supply:
        give((), min(total, usable(())))
    return out


def words(text: F.Column) -> F.Column:
    """Tokens of a text for budgets: its words."""
    return F.regexp_count(text, F.lit("[^ \\t-\\r]+")).cast("long")


def mix(docs: DataFrame, levels: dict[str, F.Column], weights: dict[tuple, float], share: float, epochs: int = 1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (row struct, epoch, tokens, tokens_used, *levels): what the mix takes, ``share`` of all tokens in size.

    ``levels`` names the tree's levels, the top one first.
    """
    spark = docs.sparkSession
    names = list(levels)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    keyed = docs.select(row, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_key"), *[F.coalesce(c.cast("string"), F.lit("\0")).alias(f"_{k}") for k, c in levels.items()])
    keyed = keyed.withColumn("_tokens", words(F.col("_text"))).drop("_text")
    leaf = [f"_{k}" for k in names]
    sizes = written(keyed.groupBy("_key", *leaf).agg(F.max("_tokens").alias("_tokens"), F.count("*").alias("_rows")), "tokens")
    totals = sizes.groupBy(*leaf).agg(F.sum(F.col("_tokens") * F.col("_rows")).alias("t"), F.sum("_rows").alias("n"))
    rows = totals.limit(MOST_LEAVES + 1).collect()
    if len(rows) > MOST_LEAVES:
        raise ValueError(f"the tree has more than {MOST_LEAVES} leaves")
    supply = {tuple(r[k] for k in leaf): r.t for r in rows}
    budget = budgets(supply, weights, math.floor(share * sum(supply.values())), epochs)
    plan = [(*k, budget[k] // t, budget[k] % t) for k, t in supply.items() if t] + [(*k, 1, 0) for k, t in supply.items() if not t]
    table = written(spark.createDataFrame(plan, ", ".join(f"{k} string" for k in leaf) + ", _full long, _part long"), "budgets")
    # The partial epoch: places in a seeded order, by buckets.
    parts = max(1, -(-sum(r.n for r in rows) // BUCKET_ROWS))
    last = sizes.join(table.where("_part > 0"), leaf)
    last = last.withColumn("_h", F.xxhash64("_key", F.lit(seed), F.col("_full"))).withColumn("_bucket", F.pmod(F.shiftrightunsigned("_h", 20), F.lit(parts)))
    last = last.withColumn("_all", F.col("_tokens") * F.col("_rows"))
    taken = prefix_sums(last, leaf, ["_bucket"], ["_h", "_key"], {"_begin": "_all"}).where("_tokens > 0 and _begin < _part")
    taken = taken.select("_key", *leaf, F.col("_begin").alias("_begin"), F.col("_part").alias("_limit"))
    from_full = keyed.join(table.where("_full > 0").select(*leaf, "_full"), leaf).withColumn("epoch", F.explode(F.expr("sequence(0L, _full - 1)"))).select("_row", *leaf, "_tokens", "epoch", F.col("_tokens").alias("tokens_used"))
    partial = keyed.join(taken, ["_key", *leaf]).join(table.select(*leaf, "_full"), leaf)
    again = F.row_number().over(Window.partitionBy("_key", *leaf).orderBy("_key"))
    partial = partial.withColumn("_begin", F.col("_begin") + (again - 1) * F.col("_tokens")).where("_begin < _limit")
    partial = partial.select("_row", *leaf, "_tokens", F.col("_full").alias("epoch"), F.least("_tokens", F.col("_limit") - F.col("_begin")).alias("tokens_used"))
    out = from_full.unionByName(partial)
    return out.select(F.col("_row").alias("row"), *[F.when(F.col(f"_{k}") != "\0", F.col(f"_{k}")).alias(k) for k in names], F.col("_tokens").alias("tokens"), "epoch", "tokens_used")


def domain() -> F.Column:
    """The domain of a document: the number of its source modulo four, named."""
    number = F.coalesce(F.regexp_extract(F.col("source"), r"(\d+)", 1).try_cast("int"), F.lit(0))
    return F.element_at(F.array(*[F.lit(x) for x in ("web", "books", "code", "news")]), F.pmod(number, F.lit(4)) + 1)


#: Weights of the query and the pipeline; nodes not named have 1.
WEIGHTS = {("web",): 4.0, ("books",): 3.0, ("code",): 1.0, ("news",): 2.0, ("web", "en"): 3.0, ("books", "en"): 2.0, ("web", "en", "src0"): 2.0}


def op5_mixing(spark, sf_dir):
    """A mix of documents of 0.7 times the corpus, up to three epochs of a leaf."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    out = mix(docs, {"domain": domain(), "lang": F.col("lang"), "source": F.col("source")}, WEIGHTS, 0.7, epochs=3, seed=5)
    return out.select("row.doc_id", "domain", "lang", "source", "tokens", "epoch", "tokens_used")


QUERIES = {"op5_mixing": op5_mixing}
SQL = {}
