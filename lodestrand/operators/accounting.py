"""Set accounting between tables: what was expected and seen, what two inventories differ in, what stands twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.session import broadcast_if_small


def accession(df: DataFrame) -> Column:
    """accession or, where it is null or empty, current_accession."""
    return F.coalesce(F.nullif(df["accession"], F.lit("")), df["current_accession"])


def account(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """key, n_expected, n_observed and one flag for each kind, for every key of either side; one shuffle of counts.

    registered: on both sides; missing: only expected; unexpected: only observed; duplicate: observed more than once.
    """
    sides = expected.select(F.col(key), F.lit(1).alias("e"), F.lit(0).alias("o")).unionByName(observed.select(F.col(key), F.lit(0).alias("e"), F.lit(1).alias("o")))
    counted = sides.groupBy(key).agg(F.sum("e").alias("n_expected"), F.sum("o").alias("n_observed"))
    return counted.select(
        key, "n_expected", "n_observed",
        ((F.col("n_expected") > 0) & (F.col("n_observed") > 0)).alias("registered"),
        (F.col("n_observed") == 0).alias("missing"),
        (F.col("n_expected") == 0).alias("unexpected"),
        (F.col("n_observed") > 1).alias("duplicate"),
    )


def account_of(expected: DataFrame, observed: DataFrame, key: str, kind: str) -> DataFrame:
    """The keys of one kind."""
    return account(expected, observed, key).where(F.col(kind)).select(key)


def is_complete(accounted: DataFrame) -> bool:
    """Whether nothing is missing, unexpected or duplicate."""
    return not accounted.where(F.col("missing") | F.col("unexpected") | F.col("duplicate")).take(1)


def mismatch(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key and status of the keys on one side only: `unreported` (left only) or `missing` (right only)."""
    counted = account(left.select(key).distinct(), right.select(key).distinct(), key)
    return counted.where(F.col("missing") | F.col("unexpected")).select(key, F.when(F.col("missing"), F.lit("unreported")).otherwise(F.lit("missing")).alias("status"))


def duplicate_content(df: DataFrame, key: str, digest: str) -> DataFrame:
    """digest, n and key of every item whose content stands more than once, one row each; nothing is merged.

    Counts come from partial sums and go back to the items, so no group is gathered, however often a content stands.
    """
    several = df.groupBy(digest).agg(F.count("*").alias("n")).where("n > 1")
    return df.select(digest, key).join(broadcast_if_small(several), digest).select(digest, "n", key)


def inventory(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """path and fault for every path that isn't declared and there alike: missing, undeclared, size, digest, repeated.

    Both sides have path, size and digest. One full outer join with null-safe comparisons.
    """
    d = declared.groupBy("path").agg(F.first("size").alias("d_size"), F.first("digest").alias("d_digest"), F.count("*").alias("d_n"))
    a = actual.select(F.col("path"), F.col("size").alias("a_size"), F.col("digest").alias("a_digest"), F.lit(True).alias("there"))
    fault = (
        F.when(F.col("d_n").isNull(), "undeclared")
        .when(F.col("there").isNull(), "missing")
        .when(F.col("d_n") > 1, "repeated")
        .when(~F.col("d_size").eqNullSafe(F.col("a_size")), "size")
        .when(~F.col("d_digest").eqNullSafe(F.col("a_digest")), "digest")
    )
    return d.join(a, "path", "full_outer").select("path", fault.alias("fault")).where(F.col("fault").isNotNull())


def successor_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path and change: added, removed, changed or preserved, by size and digest."""
    o = old.select("path", F.col("size").alias("o_size"), F.col("digest").alias("o_digest"), F.lit(True).alias("was"))
    n = new.select("path", F.col("size").alias("n_size"), F.col("digest").alias("n_digest"), F.lit(True).alias("is"))
    same = F.col("o_size").eqNullSafe(F.col("n_size")) & F.col("o_digest").eqNullSafe(F.col("n_digest"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(same, "preserved").otherwise("changed")
    return o.join(n, "path", "full_outer").select("path", change.alias("change"))


def entity_faults(entities: DataFrame, records: DataFrame) -> DataFrame:
    """Record ids that entities name but no record has (dangling), and that no entity names (orphan)."""
    named = entities.select(F.explode("record_versions").alias("record_id")).distinct()
    known = records.select("record_id").distinct()
    return mismatch(named, known, "record_id").select("record_id", F.when(F.col("status") == "unreported", "dangling").otherwise("orphan").alias("fault"))


# Names and byte sequences that no package may contain.
FORBIDDEN_NAMES = (".env", "id_rsa", "credentials.json")
FORBIDDEN_MARKERS = ("-----BEGIN PRIVATE KEY-----", "aws_secret_access_key", "OPENAI_API_KEY=")


def credential_faults(files: DataFrame) -> DataFrame:
    """path and fault (name or marker) of files (path, content) that look like credentials; bytes needn't be text."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    content = F.col("content").cast("binary")
    marked = F.coalesce(F.contains(content, F.lit(FORBIDDEN_MARKERS[0]).cast("binary")), F.lit(False))
    for marker in FORBIDDEN_MARKERS[1:]:
        marked = marked | F.coalesce(F.contains(content, F.lit(marker).cast("binary")), F.lit(False))
    fault = F.when(name.isin(*FORBIDDEN_NAMES), "name").when(marked, "marker")
    return files.select("path", fault.alias("fault")).where(F.col("fault").isNotNull())


def replicate_compare(*replicates: DataFrame) -> DataFrame:
    """request_id, n (replicates that have it), agrees (all have it with one digest), for replicates (request_id, digest).

    A request that stands twice in a replicate never agrees. One shuffle over all replicates.
    """
    union = None
    for i, r in enumerate(replicates):
        part = r.select("request_id", "digest", F.lit(i).alias("replicate"))
        union = part if union is None else union.unionByName(part)
    counted = union.groupBy("request_id").agg(F.count("*").alias("rows"), F.count_distinct("replicate").alias("n"), F.count_distinct("digest").alias("digests"), F.count("digest").alias("known"))
    agrees = (F.col("n") == len(replicates)) & (F.col("rows") == len(replicates)) & (F.col("known") == len(replicates)) & (F.col("digests") == 1)
    return counted.select("request_id", "n", agrees.alias("agrees"))


def diagnostics(pairs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key and the names of the fields that differ between a_<field> and b_<field>, in the given order; only where any does."""
    named = F.filter(F.array(*(F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    return pairs.select(key, named.alias("differs")).where(F.size("differs") > 0)
