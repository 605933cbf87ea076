"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

A source's documents are put into shards of bounded tokens, and each shard is cut into blocks of equal tokens. Blocks go
to the sources of the highest quotients target / (2 * blocks + 1), none beyond its capacity; a source's blocks go to
bundles of its shards and a bundle's blocks to its shards in the same way, by their tokens, so that no task sees more
than a bundle. A shard puts its blocks in a seeded order and gives its quota of them, after as many whole passes as the
quota holds; the last block is cut to a document. A source that holds a third of all rows is only more shards.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.llm import tokenizing
from lodestrand.session import Workspace, broadcast_if_small, table

#: Least and greatest tokens of a block, blocks that all targets' tokens are cut into between these, tokens of a shard,
#: shards of a bundle, and sources and bundles that the driver takes the totals of.
BLOCK_LEAST, BLOCK_MOST, BLOCKS, SHARD, BUNDLE, SOURCES = 64, 65_536, 8192, 4_000_000, 1024, 100_000


def sainte_lague(weights: list[float], capacities: list[int], blocks: int, names: list[str]) -> list[int]:
    """Blocks of each source by the highest quotients weight / (2 s + 1), s being what it has, none beyond its capacity.

    Equal quotients go by name. Fewer than blocks come out only if all capacities are used. The bulk is found by
    bisection of the divisor, so the cost doesn't grow with the number of blocks; a heap gives the last few.
    """
    open_ = [i for i, w in enumerate(weights) if w > 0 and capacities[i] > 0]
    blocks = min(blocks, sum(capacities[i] for i in open_))
    got = [0] * len(weights)
    if blocks <= 0:
        return got

    def at(divisor: float) -> list[int]:
        """What each has once all quotients above the divisor are served."""
        return [min(capacities[i], max(0, math.floor((weights[i] / divisor + 1) / 2))) for i in open_]

    low, high = 0.0, 2.0 * max(weights[i] for i in open_) + 1e-300
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        if middle > 0 and sum(at(middle)) < blocks:
            high = middle
        else:
            low = middle
    for i, n in zip(open_, at(high)):
        got[i] = n
    left = blocks - sum(got)
    heap = [(-weights[i] / (2 * got[i] + 1), names[i], i) for i in open_ if got[i] < capacities[i]]
    heapq.heapify(heap)
    while left > 0 and heap:
        _, name, i = heapq.heappop(heap)
        got[i] += 1
        left -= 1
        if got[i] < capacities[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), name, i))
    return got


def targets_of(df: DataFrame) -> pd.DataFrame:
    """Source, share and repeats, one row a source. Rows of one source add their shares; its least max_repeats holds.

    Null sources take no part; null, negative or not finite shares count 0; a null max_repeats counts 1.
    """
    share = F.col("target_share").cast("double")
    good = share.isNotNull() & ~F.isnan(share) & (share > 0) & (share < float("inf"))
    rows = df.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum(F.when(good, share).otherwise(0.0)).alias("share"), F.min(F.greatest(F.coalesce(F.col("max_repeats"), F.lit(1)), F.lit(0))).alias("repeats"))
    got = rows.limit(SOURCES + 1).toPandas()
    if len(got) > SOURCES:
        raise ValueError(f"more than {SOURCES} target sources")
    return got.sort_values("source", ignore_index=True)


def plan(targets: pd.DataFrame, supply: dict[str, int], total: int | None, block: int) -> pd.DataFrame:
    """Quotas in blocks. total None: as many tokens as all target sources hold, or fewer, down to where no source that
    has documents runs out of repeats, since a larger mixture would miss its shares. Sources without documents get none.
    """
    out = targets.assign(supply=[int(supply.get(s, 0)) for s in targets["source"]])
    able = (out["share"] > 0) & (out["supply"] > 0) & (out["repeats"] > 0)
    weight = out["share"].where(able, 0.0)
    most = [int(s) * int(r) for s, r in zip(out["supply"], out["repeats"])]
    if total is None:
        whole = sum(weight)
        total = min([int(out["supply"].sum()), *(int(m * whole / w) for m, w in zip(most, weight) if w > 0)])
    # the last block of a source may be a part of one, cut to its tokens on selection
    capacities = [-(-m // block) if w > 0 else 0 for m, w in zip(most, weight)]
    return out.assign(blocks=sainte_lague(list(weight), capacities, round(total / block), list(out["source"])), able=able)


def shares_of(tokens: list[int], repeats: int, blocks: int, block: int) -> list[int]:
    """Blocks of parts of one source, by their tokens, within their repeats; what rounding leaves over is cut on selection."""
    names = [f"{i:012d}" for i in range(len(tokens))]
    return sainte_lague([float(t) for t in tokens], [-(-t * repeats // block) for t in tokens], blocks, names)


def _shard_quotas(block: int):
    """Quotas of the shards of one bundle."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard", ignore_index=True)
        got = shares_of(pdf["tokens"].astype(int).tolist(), int(pdf["repeats"].iloc[0]), int(pdf["given"].iloc[0]), block)
        return pdf.assign(quota=np.array(got, np.int64))[["source", "shard", "quota", "tokens", "repeats"]]

    return run


def mix(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, total: int | None = None, block: int | None = None, shard: int = SHARD, bundle: int = BUNDLE, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixture (key, source, n_tokens, uses) and the report (source, target_share, actual_share, tokens, documents, supply, max_repeats, repeats).

    A document is used at most max_repeats times of its source; uses counts them. Documents of sources without a target,
    of null source and of no token take no part. Sources without documents get 0 and the others share what is missing
    in proportion. The same seed and rows give the same mixture, however they are partitioned. Documents are whole, so a
    source may miss its quota by a part of a document in each shard. Equal and null keys are different documents, placed
    by their texts; rows equal in key and text lie in one shard. block: tokens of a block, else the targets' tokens over
    BLOCKS, within BLOCK_LEAST and BLOCK_MOST. Other columns of documents are left out, so their names can't clash.
    """
    spark, work = documents.sparkSession, Workspace(documents.sparkSession, "mixing")
    wanted = targets_of(targets)
    sources = spark.createDataFrame(wanted[["source"]], "source string")
    own = documents.select(documents[key].alias("key"), documents["source"].alias("source"), documents[text].alias("text")).join(F.broadcast(sources), "source", "left_semi")  # at most SOURCES names
    own = own.withColumn("spread", F.xxhash64(F.lit(seed).cast("long"), F.col("key"), F.col("text")))
    counted = work.write(tokenizing.count_tokens(own, ["key", "source", "spread"], "text", tokenizer), "counted").where("n_tokens > 0")
    supply = {r["source"]: int(r["tokens"]) for r in counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).collect()}
    block = block or min(BLOCK_MOST, max(BLOCK_LEAST, sum(supply.values()) // BLOCKS))
    planned = plan(wanted, supply, total, block)
    shards = [max(1, math.ceil(s / shard)) for s in planned["supply"]]
    quotas = spark.createDataFrame([(r.source, int(r.repeats), n) for r, n in zip(planned.itertuples(), shards)], "source string, repeats long, shards int")
    placed = counted.join(F.broadcast(quotas), "source").withColumn("shard", F.pmod("spread", F.col("shards")).cast("long"))
    sizes = work.write(placed.groupBy("source", "shard").agg(F.sum("n_tokens").alias("tokens"), F.first("repeats").alias("repeats")), "sizes").withColumn("bundle", F.floor(F.col("shard") / bundle))
    bundles = sizes.groupBy("source", "bundle").agg(F.sum("tokens").alias("tokens")).orderBy("source", "bundle").limit(SOURCES + 1).toPandas()
    if len(bundles) > SOURCES:
        raise ValueError(f"more than {SOURCES} bundles of shards")
    given = []
    for r in planned.itertuples():
        part = bundles[bundles["source"] == r.source]
        got = shares_of(part["tokens"].astype(int).tolist(), int(r.repeats), int(r.blocks), block)
        given += [(r.source, int(b), int(n)) for b, n in zip(part["bundle"], got)]
    to_bundles = spark.createDataFrame(given, "source string, bundle long, given long")
    quota = sizes.join(F.broadcast(to_bundles), ["source", "bundle"]).groupBy("source", "bundle").applyInPandas(_shard_quotas(block), "source string, shard long, quota long, tokens long, repeats long")
    quota = work.write(quota, "quotas")
    here = Window.partitionBy("source", "shard")
    rows = placed.select("key", "source", "n_tokens", "shard", "spread").join(broadcast_if_small(quota), ["source", "shard"])
    take = F.least(F.col("quota") * block, F.col("tokens") * F.col("repeats"))
    rows = rows.withColumn("passes", F.floor(take / F.col("tokens"))).withColumn("rest", take - F.col("passes") * F.col("tokens"))
    # a document belongs to the block in which it begins; blocks come in the order of the seed, documents in their own
    ahead = here.orderBy("key", "spread", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("block", F.floor((F.sum("n_tokens").over(ahead) - F.col("n_tokens")) / F.lit(block)))
    rows = rows.withColumn("order", F.xxhash64(F.lit(seed).cast("long"), F.col("source"), F.col("shard"), F.col("block")))
    by = here.orderBy("order", "block", "key", "spread", "n_tokens")
    # the documents of the first blocks that lie within the quota whole, then the one that fits what is left best
    rows = rows.withColumn("nth", F.row_number().over(by)).withColumn("inside", F.sum("n_tokens").over(by.rowsBetween(Window.unboundedPreceding, 0)) <= F.col("rest"))
    rows = rows.withColumn("gap", F.col("rest") - F.coalesce(F.sum(F.when(F.col("inside"), F.col("n_tokens"))).over(here), F.lit(0)))
    rows = rows.withColumn("last", F.min(F.when(~F.col("inside"), F.struct(F.abs(F.col("gap") - F.col("n_tokens")).alias("off"), "nth"))).over(here))
    fits = ~F.col("inside") & (F.col("nth") == F.col("last.nth")) & (F.col("last.off") < F.col("gap"))
    mixed = rows.withColumn("uses", (F.col("passes") + F.when(F.col("inside") | F.coalesce(fits, F.lit(False)), 1).otherwise(0)).cast("int")).where("uses > 0").select(F.col("key").alias(key), "source", "n_tokens", "uses")
    mixed = work.write(mixed, "mixed")
    reached = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("documents"), F.max("uses").alias("repeats"))
    asked = spark.createDataFrame([(r.source, float(r.share), int(r.supply), int(r.repeats)) for r in planned.itertuples()], "source string, target_share double, supply long, max_repeats int")
    all_ = Window.partitionBy()  # at most SOURCES rows
    report = asked.join(F.broadcast(reached), "source", "left").withColumn("whole", F.sum("tokens").over(all_))
    report = report.select("source", "target_share", F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "documents")), "supply", "max_repeats", F.coalesce("repeats", F.lit(0)).alias("repeats"))
    return mixed, report


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]
