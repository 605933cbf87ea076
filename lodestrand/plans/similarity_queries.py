"""Queries over a record view of the embeddings: exact ranking, pages, filters, gates, binding and pooling, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.functions import floats
from lodestrand.operators import accounting, canonical, similarity
from lodestrand.operators.filters import Compiler
from lodestrand.session import Workspace, table

# The record view: null, quarantined and eligible states, seven provenances, one entity for each label.
VIEW_SQL = """
rec AS (
  SELECT vec_id, 'vec:' || lpad(vec_id::VARCHAR, 8, '0') AS record_id, 'label:' || label AS entity_id, 'canon-v1' AS canonicalization_id,
         'src:' || (vec_id % 7) AS source_provenance_id,
         CASE vec_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'quarantined' ELSE 'eligible' END AS lifecycle_state, embedding AS vector
  FROM embeddings
)"""
SCORE_SQL = "list_reduce(list_prepend(CAST(0 AS FLOAT), list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2])), lambda acc, x: CAST(acc + x AS FLOAT))::DOUBLE"
RANKED_SQL = f"""WITH {VIEW_SQL}, q AS (SELECT vector FROM rec WHERE vec_id = 0),
ranked AS (SELECT r.*, {SCORE_SQL.format(a="r.vector", b="q.vector")} AS score FROM rec r, q)"""


def record_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("vec_id") % 5 == 1, "quarantined").when(F.col("vec_id") % 5 > 1, "eligible")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.concat(F.lit("vec:"), F.lpad(F.col("vec_id").cast("string"), 8, "0")).alias("record_id"), F.concat(F.lit("label:"), F.col("label")).alias("entity_id"), F.lit("canon-v1").alias("canonicalization_id"),
        F.concat(F.lit("src:"), F.col("vec_id") % 7).alias("source_provenance_id"), state.alias("lifecycle_state"), F.col("embedding").alias("vector"),
    )


def ranked(spark: SparkSession, sf_dir: str, expression: object = None) -> DataFrame:
    view = record_view(spark, sf_dir)
    return similarity.scores(view.where(Compiler().compile(expression)), view.where("vec_id = 0"))


def sim_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.page(ranked(spark, sf_dir), 12)


def sim_page2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page: the first page's last key is looked up, then rows after it are ranked; scores are computed once."""
    all_rows = Workspace(spark, "ranked").write(ranked(spark, sf_dir), "scores")
    last = similarity.page(all_rows, 12).collect()[-1]
    return similarity.page(all_rows, 12, (last["score"], last["record_id"]))


def sim_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page numbers of a walk in twos over the best 12."""
    numbered = F.row_number().over(Window.orderBy(*similarity.total_order()))
    return similarity.page(ranked(spark, sf_dir), 12).select("record_id", numbered.alias("rn")).select("record_id", F.floor((F.col("rn") - 1) / 2).cast("bigint").alias("page"))


def sim_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of signs, where many scores are equal."""
    view = record_view(spark, sf_dir).withColumn("vector", F.transform("vector", lambda x: F.when(x >= 0, floats.f32(0.125)).otherwise(floats.f32(-0.125))))
    return similarity.page(similarity.scores(view, view.where("vec_id = 0")), 12)


def sim_all_pairs_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 12 best of each query in the stated query set (ids divisible by 20), against all rows."""
    view = record_view(spark, sf_dir)
    return similarity.top_of_many(view.where("vec_id % 20 = 0"), view, 12)


def sim_negative_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir).orderBy(F.asc("score"), F.desc("record_id")).limit(12)


def _field(name: str) -> dict:
    return {"kind": "canonical", "name": name}


_EQ = {"eq": {"field": _field("lifecycle_state"), "value": "eligible"}}
_IN = {"in": {"field": _field("source_provenance_id"), "values": ["src:1", "src:3"]}}
EXPRESSIONS = {
    "filter_eq": (_EQ, "lifecycle_state IS NOT DISTINCT FROM 'eligible'"),
    "filter_in": (_IN, "coalesce(source_provenance_id IN ('src:1', 'src:3'), false)"),
    "filter_not": ({"not": _EQ}, "NOT (lifecycle_state IS NOT DISTINCT FROM 'eligible')"),
    "filter_all": ({"all": [{"not": _EQ}, _IN]}, "NOT (lifecycle_state IS NOT DISTINCT FROM 'eligible') AND source_provenance_id IN ('src:1', 'src:3')"),
    "filter_any": ({"any": [_EQ, _IN]}, "lifecycle_state IS NOT DISTINCT FROM 'eligible' OR source_provenance_id IN ('src:1', 'src:3')"),
}


def _filter(expression: object):
    return lambda spark, sf_dir: record_view(spark, sf_dir).where(Compiler().compile(expression)).select("record_id", "lifecycle_state", "source_provenance_id")


def filter_then_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.page(ranked(spark, sf_dir, {"not": _EQ}), 12)


STATE_SQL = """WITH raw AS (
  SELECT vec_id, CASE vec_id % 5 WHEN 0 THEN '{}' WHEN 1 THEN '{"lifecycle_state":null}' WHEN 2 THEN '{"lifecycle_state":false}' WHEN 3 THEN '{"lifecycle_state":""}'
         ELSE '{"lifecycle_state":"eligible"}' END::JSON AS raw FROM embeddings
), typed AS (SELECT vec_id, json_type(json_extract(raw, '$.lifecycle_state')) AS kind, json_extract(raw, '$.lifecycle_state')::VARCHAR AS v FROM raw)
SELECT vec_id FROM typed WHERE """
STATES = {"present": "kind IS NOT NULL AND kind <> 'NULL' AND v <> 'false'", "missing": "kind IS NULL", "false": "kind = 'BOOLEAN' AND v = 'false'", "unavailable": "false"}


def _state(state: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        part = F.col("vec_id") % 5
        raw = F.when(part == 0, "{}").when(part == 1, '{"lifecycle_state":null}').when(part == 2, '{"lifecycle_state":false}').when(part == 3, '{"lifecycle_state":""}').otherwise('{"lifecycle_state":"eligible"}')
        view = table(spark, sf_dir, "embeddings").select("vec_id", F.parse_json(raw).alias("raw"), F.lit(None).cast("string").alias("lifecycle_state"))
        compiled = Compiler({"lifecycle_state": F.col("lifecycle_state")}, F.col("raw")).compile({"state": {"field": _field("lifecycle_state"), "is": state}})
        return view.where(compiled).select("vec_id")

    return run


_SCALE = ((0, 1.001), (1, 1.000004), (2, 1.00000045))


def _spoilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors a little too long, with NaN, with infinity, and as they are."""
    part = F.col("vec_id") % 10
    scale = F.lit(1.0)
    for i, s in _SCALE:
        scale = F.when(part == i, s).otherwise(scale)
    extra = F.when(part == 3, float("nan")).when(part == 4, float("inf")).otherwise(0.0).cast("float")
    view = record_view(spark, sf_dir)
    return view.select("record_id", F.transform("vector", lambda x: x * scale.cast("float") + extra).alias("vector"))


SPOILT_SQL = f"""WITH {VIEW_SQL}, spoilt AS (
  SELECT record_id, list_transform(vector, lambda x: CAST(CAST(x * CAST(CASE vec_id % 10 WHEN 0 THEN 1.001 WHEN 1 THEN 1.000004 WHEN 2 THEN 1.00000045 ELSE 1 END AS FLOAT) AS FLOAT)
         + CAST(CASE vec_id % 10 WHEN 3 THEN 'nan'::FLOAT WHEN 4 THEN 'infinity'::FLOAT ELSE 0 END AS FLOAT) AS FLOAT)) AS v FROM rec
)"""


def gate_query_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spoilt(spark, sf_dir).select("record_id", floats.passes_query_gate(F.col("vector")).alias("passes"))


def gate_package_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spoilt(spark, sf_dir).select("record_id", floats.passes_package_gate(F.col("vector")).alias("passes"))


def _bindable(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    view = record_view(spark, sf_dir)
    inst = F.concat(F.lit("embedding:"), F.col("record_id"), F.lit(":p"))
    ref = F.struct(F.lit("s").alias("shard_id"), F.col("vec_id").alias("row"), F.lit("d").alias("shard_digest"))
    return view, view.select(inst.alias("instance_id"), "record_id", F.lit("p").alias("profile_id"), ref.alias("vector_reference"), "vec_id"), view.select(F.col("vec_id").alias("row"), inst.alias("instance_id"))


def binding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, instances, mapping = _bindable(spark, sf_dir)
    return similarity.bind(records.select("record_id", "entity_id"), instances, mapping, "p", "s", "d")


def binding_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults put into the tables: rows left out, rows shifted, records left out, records with a second row."""
    records, instances, mapping = _bindable(spark, sf_dir)
    part = F.col("row") % 50
    second = F.concat("instance_id", F.lit(":again"))
    extra = instances.where("vec_id % 50 = 31")
    ref = F.struct(F.lit("s").alias("shard_id"), (F.col("vec_id") + 1_000_000).alias("row"), F.lit("d").alias("shard_digest"))
    instances = instances.drop("vec_id").unionByName(extra.select(second.alias("instance_id"), "record_id", "profile_id", ref.alias("vector_reference")))
    shifted = mapping.where(part != 7).select(F.when(part == 13, F.col("row") + 500_000).otherwise(F.col("row")).alias("row"), "instance_id")
    shifted = shifted.unionByName(mapping.where(part == 31).select((F.col("row") + 1_000_000).alias("row"), second.alias("instance_id")))
    return similarity.binding_faults(records.where("vec_id % 50 <> 21").select("record_id", "entity_id"), instances, shifted)


BINDING_SQL = f"""WITH {VIEW_SQL}, kept AS (SELECT * FROM rec WHERE vec_id % 50 <> 21),
inst AS (SELECT 'embedding:' || record_id || ':p' AS instance_id, record_id, vec_id AS r FROM rec
         UNION ALL SELECT 'embedding:' || record_id || ':p:again', record_id, vec_id + 1000000 FROM rec WHERE vec_id % 50 = 31),
maps AS (SELECT CASE WHEN vec_id % 50 = 13 THEN vec_id + 500000 ELSE vec_id END AS r, 'embedding:' || record_id || ':p' AS instance_id FROM rec WHERE vec_id % 50 <> 7
         UNION ALL SELECT vec_id + 1000000, 'embedding:' || record_id || ':p:again' FROM rec WHERE vec_id % 50 = 31),
m AS (SELECT maps.instance_id, inst.record_id FROM maps LEFT JOIN inst ON maps.instance_id = inst.instance_id AND maps.r = inst.r)
SELECT instance_id AS subject, 'unbound_row' AS fault FROM m WHERE record_id IS NULL
UNION ALL SELECT record_id, 'unknown_record' FROM m WHERE record_id IS NOT NULL AND record_id NOT IN (SELECT record_id FROM kept)
UNION ALL SELECT record_id, 'several_rows' FROM m WHERE record_id IS NOT NULL GROUP BY record_id HAVING count(*) > 1
UNION ALL SELECT record_id, 'uncovered_record' FROM kept WHERE record_id NOT IN (SELECT record_id FROM m WHERE record_id IS NOT NULL)"""


def entity_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of the labels against records, with some record ids only on one side."""
    view = record_view(spark, sf_dir)
    named = F.when(F.col("vec_id") % 40 == 3, F.concat(F.col("record_id"), F.lit("?"))).otherwise(F.col("record_id"))
    entities = view.select("entity_id", F.array(named).alias("record_versions"))
    return accounting.entity_faults(entities, view.where("vec_id % 40 <> 9"))


def pool_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.pooled_wide(table(spark, sf_dir, "embeddings"), ["label"], "embedding").select("label", F.col("position").cast("bigint").alias("position"), "mean")


def pool_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The means scaled to length 1; a label's components are few, its vectors are summed before."""
    mean = canonical.pooled_wide(table(spark, sf_dir, "embeddings"), ["label"], "embedding", 12)
    size = F.sqrt(F.sum(F.col("mean") * F.col("mean")).over(Window.partitionBy("label")))
    return mean.select("label", F.col("position").cast("bigint").alias("position"), F.round(F.col("mean") / size, 6).alias("component"))


POOLED_SQL = "SELECT label, unnest(generate_series(0, len(embedding) - 1)) AS position, unnest(embedding)::DOUBLE AS x FROM embeddings"
TOP12 = "SELECT record_id, entity_id, score FROM ranked ORDER BY score DESC, record_id LIMIT 12"

QUERIES = {
    "sim_topk": sim_topk, "sim_page2": sim_page2, "sim_pages": sim_pages, "sim_ties": sim_ties, "sim_all_pairs_topk": sim_all_pairs_topk, "sim_negative_tail": sim_negative_tail,
    **{name: _filter(e) for name, (e, _) in EXPRESSIONS.items()}, "filter_then_rank": filter_then_rank, **{f"filter_state_{s}": _state(s) for s in STATES},
    "gate_query_norm": gate_query_norm, "gate_package_norm": gate_package_norm, "binding_join": binding_join, "binding_violations": binding_violations, "entity_closure": entity_closure,
    "pool_mean": pool_mean, "pool_l2": pool_l2,
}

ORACLES = {
    "sim_topk": f"{RANKED_SQL} {TOP12}",
    "sim_page2": f"{RANKED_SQL} {TOP12} OFFSET 12",
    "sim_pages": f"{RANKED_SQL} SELECT record_id, (row_number() OVER (ORDER BY score DESC, record_id) - 1) // 2 AS page FROM (SELECT * FROM ranked ORDER BY score DESC, record_id LIMIT 12)",
    "sim_ties": RANKED_SQL.replace("embedding AS vector", "list_transform(embedding, lambda x: CAST(CASE WHEN x >= 0 THEN 0.125 ELSE -0.125 END AS FLOAT)) AS vector") + " " + TOP12,
    "sim_all_pairs_topk": f"""WITH {VIEW_SQL}, s AS (SELECT q.record_id AS query_id, c.record_id, {SCORE_SQL.format(a="c.vector", b="q.vector")} AS score FROM rec q, rec c WHERE q.vec_id % 20 = 0),
        n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rn FROM s) SELECT query_id, record_id, score, rn FROM n WHERE rn <= 12""",
    "sim_negative_tail": f"{RANKED_SQL} SELECT record_id, entity_id, score FROM ranked ORDER BY score, record_id DESC LIMIT 12",
    **{name: f"WITH {VIEW_SQL} SELECT record_id, lifecycle_state, source_provenance_id FROM rec WHERE {sql}" for name, (_, sql) in EXPRESSIONS.items()},
    "filter_then_rank": f"{RANKED_SQL} SELECT record_id, entity_id, score FROM ranked WHERE {EXPRESSIONS['filter_not'][1]} ORDER BY score DESC, record_id LIMIT 12",
    **{f"filter_state_{s}": STATE_SQL + sql for s, sql in STATES.items()},
    "gate_query_norm": f"""{SPOILT_SQL} SELECT record_id, len(list_filter(v, lambda x: NOT isfinite(x))) = 0 AND coalesce(abs({SCORE_SQL.format(a="v", b="v")} - 1.0) <= 1e-5, false) AS passes FROM spoilt""",
    "gate_package_norm": f"""{SPOILT_SQL} SELECT record_id, len(list_filter(v, lambda x: NOT isfinite(x))) = 0
        AND abs(sqrt(list_sum(list_transform(v, lambda x: CASE WHEN isfinite(x) THEN x::DOUBLE * x::DOUBLE ELSE 0 END))) - 1.0) <= 1e-6 AS passes FROM spoilt""",
    "binding_join": f"WITH {VIEW_SQL} SELECT record_id, entity_id, vec_id AS row FROM rec",
    "binding_violations": BINDING_SQL,
    "entity_closure": f"""WITH {VIEW_SQL}, named AS (SELECT DISTINCT CASE WHEN vec_id % 40 = 3 THEN record_id || '?' ELSE record_id END AS record_id FROM rec), known AS (SELECT DISTINCT record_id FROM rec WHERE vec_id % 40 <> 9)
        SELECT record_id, 'dangling' AS fault FROM named WHERE record_id NOT IN (SELECT record_id FROM known) UNION ALL SELECT record_id, 'orphan' FROM known WHERE record_id NOT IN (SELECT record_id FROM named)""",
    "pool_mean": f"SELECT label, position, round(avg(x), 6) AS mean FROM ({POOLED_SQL}) GROUP BY label, position",
    "pool_l2": f"WITH m AS (SELECT label, position, round(avg(x), 12) AS mean FROM ({POOLED_SQL}) GROUP BY label, position) SELECT label, position, round(mean / sqrt(sum(mean * mean) OVER (PARTITION BY label)), 6) AS component FROM m",
}
