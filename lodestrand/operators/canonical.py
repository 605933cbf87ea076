"""From source files to canonical sequences, and from these to windows and pooled vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions import floats, texts
from lodestrand.session import Workspace, spread

WINDOW = 8191  # fixed value: bases of a window, after which one token of the prefix follows
PREFIX = "<s>"


def contigs(files: DataFrame, key: str = "accession", text: str = "fasta") -> DataFrame:
    """key, ordinal, contig_id (null if the header has none), bases and stray (text before the first header).

    One row for each header, and one of ordinal 0 for text before it. Lines end at LF, CR or both. A file is cut at its
    headers where it is read: no shuffle, no window, and a file stays whole, as its digest needs.
    """
    plain = F.regexp_replace(F.col(text), "\r\n|\r", "\n")
    cut = files.select(F.col(key), F.posexplode(F.split(plain, "(?md)^>")).alias("ordinal", "part"))  # (?d): only LF ends a line
    first, end = F.col("ordinal") == 0, F.instr("part", "\n")
    header = F.when(end > 0, F.substr("part", F.lit(1), end - 1)).otherwise(F.col("part"))
    body = F.when(first, F.col("part")).when(end > 0, F.substr("part", end + 1)).otherwise(F.lit(""))
    name = F.when(~first, F.nullif(F.regexp_extract(header, r"^[ \t\f\x0b]*([^ \t\f\x0b]*)", 1), F.lit("")))
    return cut.select(key, F.col("ordinal").cast("bigint").alias("ordinal"), name.alias("contig_id"), texts.canonical_bases(body).alias("bases")).where((F.col("ordinal") > 0) | (F.col("bases") != ""))


def reasons(found: DataFrame, reported: DataFrame, key: str = "accession") -> DataFrame:
    """key and reason (null where all is well) of each file, by its contigs and its report rows (key, contig_id)."""
    checked = found.groupBy(key).agg(
        F.bool_or(F.col("ordinal") == 0).alias("stray"),
        F.bool_or((F.col("ordinal") > 0) & F.col("contig_id").isNull()).alias("nameless"),
        F.bool_or(F.col("contig_id").rlike(r"[^\x00-\x7f]")).alias("foreign"),
        (F.count("contig_id") > F.count_distinct("contig_id")).alias("repeated"),
        F.bool_or((F.col("ordinal") > 0) & ~texts.is_canonical(F.col("bases"))).alias("illegal"),
    )
    pairs = found.where(F.col("contig_id").isNotNull()).select(key, "contig_id").distinct().withColumn("f", F.lit(1)).join(reported.groupBy(key, "contig_id").agg(F.count("*").alias("r")), [key, "contig_id"], "full_outer")
    paired = pairs.groupBy(key).agg(F.bool_or(F.col("f").isNull() | F.col("r").isNull()).alias("unpaired"), F.bool_or(F.col("r") > 1).alias("reported_twice"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    reason = (
        F.when(F.col("stray"), "sequence before the first header")
        .when(flag("nameless"), "a header without identifier")
        .when(flag("foreign"), "an identifier outside ASCII")
        .when(F.col("repeated"), "a repeated identifier")
        .when(flag("illegal"), "an empty sequence or an unknown base")
        .when(flag("reported_twice"), "a repeated report row")
        .when(flag("unpaired"), "sequences and report rows disagree")
    )
    return checked.join(paired, key, "left").select(key, reason.alias("reason"))


def canonical_files(found: DataFrame, key: str = "accession") -> DataFrame:
    """key, canonical text (a line `id TAB bases` for each contig in order of id) and its digest."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("contig_id", "bases"))), lambda c: F.concat(c["contig_id"], F.lit("\t"), c["bases"], F.lit("\n")))
    return found.groupBy(key).agg(F.array_join(lines, "").alias("canonical")).select(key, "canonical", texts.digest(F.col("canonical")).alias("digest"))


def identities(df: DataFrame, key: str, namespace: str, profile: str) -> DataFrame:
    """entity_id (the accession without its version) and record_id of each accession."""
    return df.select(key, F.concat(F.lit(f"{namespace}:"), texts.entity_of(F.col(key))).alias("entity_id"), F.concat(F.lit(f"{namespace}:"), F.col(key), F.lit(f":{profile}")).alias("record_id"))


def windows(df: DataFrame, keys: list[str], bases: str, size: int = WINDOW) -> DataFrame:
    """keys, window_no, start and window of consecutive windows that never cross sequences; the last may be short.

    An empty or null sequence has none.
    """
    held = df.where(F.length(bases) > 0)
    starts = held.select(*keys, F.col(bases).alias("__bases"), F.posexplode(F.sequence(F.lit(0), F.length(bases) - 1, F.lit(size))).alias("window_no", "start"))
    return starts.select(*keys, "window_no", "start", F.substr(F.col("__bases"), F.col("start") + 1, F.lit(size)).alias("window"))


def pooled(df: DataFrame, keys: list[str], order: str, vector: str, unit: bool = False) -> DataFrame:
    """keys and the mean of the vectors of each group in order, in double with compensated sums, scaled to length 1 if unit.

    For the windows of one sequence, whose number is bounded by its length; null where lengths differ or it can't be scaled.
    """
    mean = df.groupBy(*keys).agg(floats.mean_of(F.collect_list(F.struct(F.col(order).alias("i"), F.col(vector).alias("v")))).alias("pooled"))
    return mean.select(*keys, floats.normalised(F.col("pooled")).alias("pooled")) if unit else mean


def pooled_wide(df: DataFrame, keys: list[str], vector: str, places: int = 6) -> DataFrame:
    """keys, position and mean of each component, rounded, for groups of any size: partial sums before the shuffle.

    The order of addition isn't fixed, so the last bits may differ from pooled(); rounding hides it.
    """
    return df.select(*keys, F.posexplode(vector).alias("position", "x")).groupBy(*keys, "position").agg(F.round(F.avg(F.col("x").cast("double")), places).alias("mean"))


def rows_of(df: DataFrame, order: Column, out: str = "row") -> DataFrame:
    """df with its row number from 0 in the given unique order, without bringing all rows to one task.

    Rows are ranged into partitions and written, so that counting and numbering see the same partitions; only the
    partitions' counts are gathered.
    """
    work = Workspace(df.sparkSession, "rows")
    ranged = work.write(df.withColumn("__key", order).repartitionByRange(spread(df), "__key").withColumn("__part", F.spark_partition_id()), "ranged")
    firsts = ranged.groupBy("__part").agg(F.count("*").alias("n"), F.min("__key").alias("low"))
    before = firsts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__part", "before")
    by = Window.partitionBy("__part").orderBy("__key")
    return ranged.join(F.broadcast(before), "__part").withColumn(out, (F.col("before") + F.row_number().over(by) - 1).cast("bigint")).drop("__key", "__part", "before")


def eligible(records: DataFrame, digests: DataFrame, canonicalization_id: str) -> DataFrame:
    """Eligible records whose canonicalization is the expected one and whose file's digest is the declared one."""
    wanted = records.where((F.col("lifecycle_state") == "eligible") & (F.col("canonicalization_id") == canonicalization_id))
    return wanted.join(digests, (wanted["record_id"] == digests["record_id"]) & (wanted["sequence_digest"] == digests["digest"]), "left_semi")


def pending(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Rows that a resumed stage still has to embed: those that no finished row of the same run specification covers."""
    return rows.join(done.select("run_spec", "row"), ["run_spec", "row"], "left_anti")


def report_rows(files: DataFrame, key: str = "accession", text: str = "report", member: str = "refseqAccession") -> DataFrame:
    """key, contig_id and fault of the rows of JSON-lines reports (key, text): blank lines skipped.

    fault: `json` for a line that is no object, `member` for a missing, empty or non-text identifier, `repeated` for one
    that stands twice in its report, null for a good row. A report without rows gives none; reasons() then finds the
    sequences unpaired.
    """
    lines = files.select(F.col(key), F.explode(F.split(F.col(text), "\r\n|\n|\r")).alias("line")).where(F.length(F.trim("line")) > 0)
    parsed = lines.select(key, F.try_parse_json("line").alias("raw"))
    held = F.try_variant_get("raw", f"$.{member}", "variant")
    name = F.when(F.schema_of_variant(held) == "STRING", F.nullif(F.try_variant_get("raw", f"$.{member}", "string"), F.lit("")))
    named = parsed.select(key, F.coalesce(F.schema_of_variant("raw").startswith("OBJECT"), F.lit(False)).alias("object"), name.alias("contig_id"))
    times = F.count("*").over(Window.partitionBy(key, "contig_id"))
    fault = F.when(~F.col("object"), "json").when(F.col("contig_id").isNull(), "member").when(times > 1, "repeated")
    return named.select(key, "contig_id", fault.alias("fault"))


def contig_lines(files: DataFrame, key: str = "accession", text: str = "canonical") -> DataFrame:
    """key, ordinal, contig_id and bases of canonical files, a line `id TAB bases` each; fault where a line has no tab or an empty side."""
    lines = files.select(F.col(key), F.posexplode(F.split(F.regexp_replace(F.col(text), "\n$", ""), "\n")).alias("ordinal", "line"))
    parts = F.split("line", "\t", 2)
    broken = F.coalesce((F.size(parts) < 2) | (F.get(parts, F.lit(0)) == "") | (F.get(parts, F.lit(1)) == "") | F.get(parts, F.lit(1)).contains("\t"), F.lit(True))
    return lines.select(key, "ordinal", F.get(parts, F.lit(0)).alias("contig_id"), F.get(parts, F.lit(1)).alias("bases"), broken.alias("fault"))
