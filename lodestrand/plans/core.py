"""The query core: one request in, one result envelope out, with typed errors in a fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.functions import floats
from lodestrand.operators import similarity
from lodestrand.operators.filters import Compiler, FilterRefused
from lodestrand.plans import request as R
from lodestrand.plans.release import Release
from lodestrand.session import Workspace

# Messages of the result contract.
OTHER_RELEASE = "release selector does not identify this verified release"
NO_TRAVERSAL = "this verified M1 Draft declares no DerivedRelation artifact for traversal"
NO_PROFILE = "selected profile is not declared by the verified release"
OTHER_PROFILE = "selected profile is incompatible with exact cosine"
NO_RECORD = "query_record_id is not present in the selected profile"
BAD_VECTORS = "selected profile has non-finite or non-normalized vectors"
OTHER_BINDING = "cursor does not bind this release and canonical request"
NO_KEY = "cursor last key is not present in this result ordering"
WARNING = {"code": "method_not_evaluated", "message": "Method evidence has not been evaluated."}


class _Stop(Exception):
    def __init__(self, code: str, message: str, stage: str, field: str | None = None) -> None:
        self.fault = R.Fault(code, message, stage, field)


class QueryCore:
    """Answers requests against one open release."""

    def __init__(self, release: Release) -> None:
        self.release = release

    def execute(self, text: str) -> dict:
        try:
            request = R.canonicalise(text)
        except R.RequestRefused as e:
            return R.Fault(e.code, str(e), "validate").envelope(R.raw_correlation(text))
        try:
            return self._traversal(request) if request.payload.get("operation") == "traversal" else self._similarity(request)
        except _Stop as e:
            return e.fault.envelope(request.correlation)

    def _selected(self, request: R.Request) -> None:
        selector = request.payload["release_selector"]
        if (selector["release_id"], selector["release_digest"]) != (self.release.release_id, self.release.digest):
            raise _Stop("release_not_found", OTHER_RELEASE, "resolve", "release_selector")

    def _traversal(self, request: R.Request) -> dict:
        holds, fault = R.TRAVERSAL_CHECK
        if not holds(request.payload):
            return fault.envelope(request.correlation)
        self._selected(request)
        raise _Stop("unsupported_relation", NO_TRAVERSAL, "plan", "traversal")

    def _profile(self, request: R.Request) -> dict:
        wanted, profile, shard = request.payload["profile_selector"], self.release.profile, self.release.shard
        if profile is None or wanted["profile_id"] != profile["profile_id"]:
            raise _Stop("profile_incompatible", NO_PROFILE, "resolve")
        fits = wanted["profile_version"] == profile["version"] and (profile["normalization"], profile["metric"], profile["metric_direction"]) == ("l2", "cosine", "higher-is-more-similar")
        if not fits or profile["dtype"] != "float32" or shard["dtype"] != "float32" or profile["dimension"] != shard["dimension"]:
            raise _Stop("profile_incompatible", OTHER_PROFILE, "plan")
        return profile

    def _similarity(self, request: R.Request) -> dict:
        payload, release = request.payload, self.release
        fault = R.validate(payload)
        if fault:
            return fault.envelope(request.correlation)
        self._selected(request)
        profile = self._profile(request)
        rows, why = release.binding
        if rows is None:
            raise _Stop("release_untrusted", why, "resolve")
        query_id = payload["similarity"]["query_record_id"]
        query = rows.where(F.col("record_id") == query_id).select("vector", F.coalesce(floats.passes_query_gate(F.col("vector")), F.lit(False)).alias("ok")).take(1)
        if not query:
            raise _Stop("validation_error", NO_RECORD, "validate", "similarity.query_record_id")
        try:
            selected = Compiler(raw=F.try_parse_json("raw_text")).compile(payload["filter"])
        except FilterRefused as e:
            raise _Stop(e.code, e.message, "plan", "filter") from e
        if not query[0]["ok"]:
            raise _Stop("profile_incompatible", BAD_VECTORS, "plan")
        # one pass over the vectors serves the gate, the cursor's key and the page; what they read then is narrow
        gate = F.coalesce(floats.passes_query_gate(F.col("vector")), F.lit(False)).alias("ok")
        scored = similarity.scores(rows.where(selected), query[0]["vector"], gate)
        work = Workspace(release.work.spark, "request")
        try:
            return self._answer(request, profile, work.write(scored, "scored"))
        finally:
            work.clear()

    def _answer(self, request: R.Request, profile: dict, ranked: DataFrame) -> dict:
        payload, release = request.payload, self.release
        if ranked.where("not ok").take(1):
            raise _Stop("profile_incompatible", BAD_VECTORS, "plan")
        binding = R.binding_digest(request)
        after = self._after(payload["pagination"]["cursor"], binding, ranked)
        limit = int(payload["pagination"]["limit"])
        page = similarity.page(ranked, limit + 1, after).collect()
        shown, cursor = page[:limit], None
        if len(page) > limit:
            cursor = R.encode_cursor(release.digest, binding, shown[-1]["score"], shown[-1]["record_id"])
        return {
            "schema_version": R.RESULT_VERSION,
            "outcome": "success",
            "context": {"release_id": release.release_id, "release_digest": release.digest, "canonical_request_digest": binding, "ordering_version": R.ORDERING, "profile_id": profile["profile_id"], "metric": profile["metric"], "metric_direction": profile["metric_direction"], "mode": "exact"},
            "rows": [{"record_id": r["record_id"], "score": r["score"], "entity_id": r["entity_id"]} for r in shown],
            "next_cursor": cursor,
            "provenance": {"release_digest": release.digest, "vector_shard_digest": release.shard_digest, "profile_version": profile["version"], "profile_digest": profile["digest"]},
            "evidence_status": {"release_integrity": "verified", "method": "not-evaluated"},
            "warnings": [dict(WARNING)],
            "error": None,
        }

    def _after(self, cursor: str | None, binding: str, ranked: object) -> tuple[float, str] | None:
        if cursor is None:
            return None
        refuse = lambda message: _Stop("invalid_cursor", message, "validate", "pagination.cursor")
        try:
            held = R.decode_cursor(cursor)
        except ValueError as e:
            raise refuse(str(e)) from e
        if (held["release_digest"], held["canonical_request_digest"]) != (self.release.digest, binding):
            raise refuse(OTHER_BINDING)
        key = float(held["last_key"]["score"]), held["last_key"]["record_id"]
        if not similarity.has_key(ranked, *key):
            raise refuse(NO_KEY)
        return key


def walk(core: QueryCore, payload: dict, pages: int = 1000) -> list[dict]:
    """All rows of a request by following its cursors, at most so many pages."""
    import json

    rows, cursor = [], None
    for _ in range(pages):
        result = core.execute(json.dumps(payload | {"pagination": (payload.get("pagination") or {}) | {"cursor": cursor}}))
        if result["outcome"] != "success":
            raise ValueError(result["error"]["message"])
        rows += result["rows"]
        cursor = result["next_cursor"]
        if cursor is None:
            return rows
    raise ValueError(f"more than {pages} pages")
