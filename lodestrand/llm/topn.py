"""Top N items within every group by statistics-guided skipping.

The rows of groups of more than N are laid out once as Parquet files clustered by group: groups of about equal size lie
together, a hot one is spread over files by its items, and a file's row groups are in descending score. A row group is
skipped if its greatest score, from the footer, is strictly below the N-th best so far of every group that it holds.
Which groups those are is read from its group columns alone, which are small; scores, ties and items stay unread. Groups
of up to N rows need no ranking and pass by.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.session import Workspace, broadcast_if_small, spread, table

#: Rows of a row group, the unit of skipping, and rows of a group from which it is spread over files.
ROW_GROUP, HOT = 8192, 1_000_000
FILES_PER_TASK = 4


def _best(frame: pd.DataFrame, n: int) -> pd.DataFrame:
    """The n best distinct items of each group code: by score, then tie (null first), then item (null last)."""
    frame = frame.assign(known=frame["tie"].notna()).sort_values(["code", "score", "known", "tie", "item"], ascending=[True, False, True, True, True], kind="stable")
    frame = frame[~frame.duplicated(["code", "item"])]
    return frame[frame.groupby("code").cumcount() < n].drop(columns="known")


def _reader(groups: list[str], n: int, columns: list[str], seen: list | None = None):
    """seen: gets (row groups, row groups read) of each chunk of files, for tests."""
    import pyarrow.fs as pfs
    import pyarrow.parquet as pq

    def greatest(meta: object) -> float:
        s = next(meta.column(i).statistics for i in range(meta.num_columns) if meta.column(i).path_in_schema == "score")
        return s.max if s is not None and s.has_min_max else math.inf

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, chunk in batch.groupby("chunk"):
                opened, found = {}, []
                for uri in chunk["path"]:
                    fs, path = pfs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
                    opened[uri] = pq.ParquetFile(fs.open_input_file(path))
                    meta = opened[uri].metadata
                    found += [(greatest(meta.row_group(i)), uri, i) for i in range(meta.num_row_groups)]
                found.sort(key=lambda x: -x[0])
                codes: dict[tuple, int] = {}
                bound = np.zeros(0)  # of each group the N-th best score so far, -inf while there are fewer
                best, reads = None, 0
                for most, uri, i in found:
                    held = opened[uri].read_row_group(i, columns=groups).to_pandas()
                    once = held.drop_duplicates()
                    plain = once.astype(object).where(once.notna(), None)
                    once = once.assign(code=[codes.setdefault(k, len(codes)) for k in zip(*(plain[g] for g in groups))])
                    code = held.merge(once, on=groups, how="left")["code"].to_numpy(np.int64)  # nulls meet nulls
                    bound = np.concatenate([bound, np.full(len(codes) - len(bound), -np.inf)])
                    if len(code) and (bound[code] > most).all():
                        continue
                    reads += 1
                    rest = opened[uri].read_row_group(i, columns=["score", "tie", "item"]).to_pandas().assign(code=code)
                    rest = rest[rest["score"].to_numpy() >= bound[code]]
                    best = _best(rest if best is None else pd.concat([best, rest]), n)
                    last = best.groupby("code")["score"].agg(["size", "min"])
                    full = last[last["size"] >= n]
                    bound[full.index.to_numpy()] = full["min"].to_numpy()
                if seen is not None:
                    seen.append((len(found), reads))
                if best is not None:
                    names = list(codes)
                    yield best.assign(**{g: pd.Series([names[c][j] for c in best["code"]], index=best.index, dtype=object) for j, g in enumerate(groups)})[columns]

    return read


def clustered(df: DataFrame, work: Workspace, groups: list[str], row_group: int = ROW_GROUP) -> list[str]:
    """Writes df, with columns groups, rows (how many the group has), score, tie and item, as files clustered by group; gives their paths."""
    tier = F.floor(F.log2("rows")).cast("int")
    part = F.pmod(F.xxhash64("item", "tie", "score"), F.greatest(F.ceil(F.col("rows") / HOT), F.lit(1)))
    placed = df.withColumn("tier", tier).withColumn("place", F.xxhash64(*groups, part))
    laid = placed.repartitionByRange(spread(df), "tier", "place").sortWithinPartitions(F.desc("score")).select(*groups, "score", "tie", "item")
    laid.write.option("parquet.block.row.count.limit", str(row_group)).parquet(work.path("clustered"))
    return sorted(df.sparkSession.read.schema(laid.schema).parquet(work.path("clustered")).inputFiles())


def top_n(df: DataFrame, groups: list[str], score: Column, tie: str, item: str, n: int = 10, row_group: int = ROW_GROUP) -> DataFrame:
    """For every group the n items of the highest score, equal scores by tie ascending in code points, then by item.

    Columns: groups, item, tie, `score` and `position` from 1. Other columns of df are left out, so their names can't
    clash. Scores that are null, NaN or infinite take no part; -0.0 equals 0.0; null group values are one value; a null
    tie comes first. An item delivered more than once in a group counts once, with its best row. Groups with fewer
    items come out whole; an empty table gives no row. For lowest first, give the negated score.

    The rows are shuffled once, to the layout; counts of groups and at most n rows of each group and file besides.
    """
    spark = df.sparkSession
    names = [f"g{i}" for i in range(len(groups))]
    value = score.cast("double") + F.lit(0.0)
    rows = df.select(*(df[g].alias(x) for g, x in zip(groups, names)), value.alias("score"), df[tie].alias("tie"), df[item].alias("item"))
    rows = rows.where(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf")))
    work = Workspace(spark, "topn")
    sizes = work.write(rows.groupBy(*names).agg(F.count("*").alias("rows")), "sizes")
    same = None
    large = sizes.select(*(F.col(x).alias(f"{x}_") for x in names), "rows").where(F.col("rows") > n)
    for x in names:
        same = rows[x].eqNullSafe(large[f"{x}_"]) if same is None else same & rows[x].eqNullSafe(large[f"{x}_"])
    columns = [*names, "score", "tie", "item"]
    paths = clustered(rows.join(broadcast_if_small(large), same).select(*columns, "rows"), work, names, row_group)
    few = sizes.select(*(F.col(x).alias(f"{x}_") for x in names), "rows").where(F.col("rows") <= n)
    same = None
    for x in names:
        same = rows[x].eqNullSafe(few[f"{x}_"]) if same is None else same & rows[x].eqNullSafe(few[f"{x}_"])
    candidates = rows.join(broadcast_if_small(few), same, "left_semi").select(*columns)
    if paths:
        chunk = lambda i: i // FILES_PER_TASK if len(paths) > 64 else i
        chunks = spark.createDataFrame([(chunk(i), p) for i, p in enumerate(paths)], "chunk long, path string")
        read = chunks.repartitionByRange(chunk(len(paths) - 1) + 1, "chunk").mapInPandas(_reader(names, n, columns), rows.schema)
        candidates = candidates.unionByName(read)
    by = Window.partitionBy(*names)
    # one exchange by group serves both steps. An item can come from two files if it was delivered twice; the best one counts
    best = candidates.repartition(*names).groupBy(*names, "item").agg(F.min(F.struct((-F.col("score")).alias("down"), "tie")).alias("b")).select(*names, "item", (-F.col("b.down")).alias("score"), F.col("b.tie").alias("tie"))
    ranked = best.withColumn("position", F.row_number().over(by.orderBy(F.desc("score"), "tie", "item"))).where(F.col("position") <= n)
    return ranked.select(*(F.col(x).alias(g) for g, x in zip(groups, names)), F.col("item").alias(item), F.col("tie").alias(tie), "score", "position")


def best_comparisons(spark: SparkSession, sf_dir: str, n: int = 10) -> DataFrame:
    """The best comparisons of each query record and profile, by the direction of the profile's metric.

    Comparisons whose profile is unknown or names no direction can't be ranked and take no part.
    """
    directions = table(spark, sf_dir, "profiles").select(F.col("profile_id"), F.when(F.col("metric_direction") == "higher-is-more-similar", 1.0).when(F.col("metric_direction") == "lower-is-more-similar", -1.0).alias("sign"))
    directions = directions.where(F.col("sign").isNotNull()).groupBy("profile_id").agg(F.first("sign").alias("sign"))
    rows = table(spark, sf_dir, "comparisons").select("comparison_id", "query_record_id", "record_id", "profile_id", "score").join(broadcast_if_small(directions), "profile_id")
    return top_n(rows, ["query_record_id", "profile_id"], F.col("score") * F.col("sign") + F.lit(0.0), "record_id", "comparison_id", n)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_comparisons(spark, sf_dir).select("query_record_id", "comparison_id")


P4_SQL = """
WITH once AS (
  SELECT DISTINCT c.comparison_id, c.query_record_id, c.profile_id, c.record_id,
         CASE WHEN p.metric_direction = 'higher-is-more-similar' THEN c.score ELSE -c.score END + 0.0 AS goodness
  FROM comparisons c JOIN profiles p USING (profile_id)
  WHERE c.score IS NOT NULL AND isfinite(c.score)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_record_id, profile_id ORDER BY goodness DESC, record_id, comparison_id) AS rn FROM once
)
SELECT query_record_id, comparison_id FROM ranked WHERE rn <= 10
"""
