"""The filter grammar compiled to columns of two-valued logic.

Every predicate is true or false, never null, so `not` is plain negation and comparisons with null-safe equality still
reach the Parquet scan. Operators that a release can't answer are refused while compiling, before anything runs, in
whatever branch they stand.
"""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fields, operators, states and messages of the grammar.
FIELDS = ("record_id", "entity_id", "canonicalization_id", "source_provenance_id", "lifecycle_state")
STATES = ("present", "missing", "unavailable", "false")
MESSAGES = {
    "operator": "FilterExpression must contain exactly one operator",
    "operands": "{} filter requires one or more operands",
    "field": "FilterExpression FieldRef is invalid",
    "annotation": "annotation assertions are not declared by this verified release",
    "eq": "equality filter is invalid",
    "in": "membership filter is invalid",
    "state": "state filter is invalid",
    "range": "range filter is invalid",
    "bounds": "range filter requires one lower and one upper numeric bound",
    "unit": "no numeric canonical field with declared units is available in this verified release",
    "relation": "relation filter is invalid",
    "no_relation": "relation filters require a declared DerivedRelation artifact",
}


class FilterRefused(Exception):
    """A filter that is malformed (validation_error) or asks for what the release doesn't declare."""

    def __init__(self, code: str, key: str, *parts: str) -> None:
        self.code, self.message = code, MESSAGES[key].format(*parts)
        super().__init__(self.message)


def _members(value: object, key: str, needed: set[str], also: set[str] = frozenset()) -> Mapping[str, object]:
    if isinstance(value, Mapping) and needed <= set(value) <= needed | also:
        return value
    raise FilterRefused("validation_error", key)


def _named(value: object) -> bool:
    return isinstance(value, str) and value != ""


def _field(value: object) -> str:
    if isinstance(value, Mapping):
        kind, rest = value.get("kind"), set(value) - {"kind"}
        if kind == "canonical" and rest == {"name"} and value["name"] in FIELDS:
            return value["name"]
        if kind == "annotation" and rest == {"source", "predicate"} and _named(value["source"]) and _named(value["predicate"]):
            raise FilterRefused("unsupported_filter", "annotation")
    raise FilterRefused("validation_error", "field")


def _is_scalar(value: object) -> bool:
    return isinstance(value, (str, bool, int, float, Decimal))


class Compiler:
    """Compiles expressions against a table with the record fields as string columns and, for presence, a VARIANT.

    Without `raw` a null column counts as absent. With it, absent, null and false are told apart.
    """

    def __init__(self, columns: Mapping[str, Column] | None = None, raw: Column | None = None) -> None:
        self.columns = columns or {name: F.col(name) for name in FIELDS}
        self.raw = raw
        self.operators = {"all": self._all, "any": self._any, "not": self._not, "eq": self._eq, "in": self._in, "state": self._state, "range": self._range, "relation": self._relation}

    def compile(self, expression: object) -> Column:
        """The predicate of an expression; None selects every record."""
        if expression is None:
            return F.lit(True)
        if not isinstance(expression, Mapping) or len(expression) != 1 or not set(expression) <= set(self.operators):
            raise FilterRefused("validation_error", "operator")
        ((name, value),) = expression.items()
        return self.operators[name](value)

    def _children(self, name: str, value: object) -> list[Column]:
        if not isinstance(value, list) or not value:
            raise FilterRefused("validation_error", "operands", name)
        return [self.compile(child) for child in value]

    def _all(self, value: object) -> Column:
        return reduce(Column.__and__, self._children("all", value))

    def _any(self, value: object) -> Column:
        return reduce(Column.__or__, self._children("any", value))

    def _not(self, value: object) -> Column:
        return ~self.compile(value)

    def _eq(self, value: object) -> Column:
        parts = value if isinstance(value, Mapping) else {}
        if set(parts) != {"field", "value"} or not _is_scalar(parts["value"]):
            raise FilterRefused("validation_error", "eq")
        column = self.columns[_field(parts["field"])]
        return column.eqNullSafe(F.lit(parts["value"])) if isinstance(parts["value"], str) else self._other_scalar(parts["field"]["name"], [parts["value"]])

    def _in(self, value: object) -> Column:
        parts = value if isinstance(value, Mapping) else {}
        values = parts.get("values")
        if set(parts) != {"field", "values"} or not isinstance(values, list) or not values or not all(map(_is_scalar, values)):
            raise FilterRefused("validation_error", "in")
        column = self.columns[_field(parts["field"])]
        texts = [v for v in values if isinstance(v, str)]
        found = (column.isNotNull() & column.isin(texts)) if texts else F.lit(False)
        others = [v for v in values if not isinstance(v, str)]
        return found | self._other_scalar(parts["field"]["name"], others) if others else found

    def _other_scalar(self, name: str, values: list) -> Column:
        """Fields are strings: a number or boolean can only match one that the raw record spells so; types aren't mixed."""
        if self.raw is None:
            return F.lit(False)
        kind = F.schema_of_variant(self._held(name))
        flags = [v for v in values if isinstance(v, bool)]
        if not flags:
            return F.lit(False)
        return F.coalesce((kind == "BOOLEAN") & F.try_variant_get(self.raw, f"$.{name}", "boolean").isin(flags), F.lit(False))

    def _held(self, name: str) -> Column:
        return F.try_variant_get(self.raw, f"$.{name}", "variant")

    def _state(self, value: object) -> Column:
        parts = value if isinstance(value, Mapping) else {}
        if set(parts) != {"field", "is"} or parts["is"] not in STATES:
            raise FilterRefused("validation_error", "state")
        name, state = _field(parts["field"]), parts["is"]
        if state == "unavailable":
            return F.lit(False)
        if self.raw is None:
            return {"missing": self.columns[name].isNull(), "present": self.columns[name].isNotNull(), "false": F.lit(False)}[state]
        held = self._held(name)
        false = F.coalesce(F.schema_of_variant(held) == "BOOLEAN", F.lit(False)) & F.coalesce(~F.try_variant_get(self.raw, f"$.{name}", "boolean"), F.lit(False))
        if state == "missing":
            return held.isNull()
        return false if state == "false" else held.isNotNull() & ~F.coalesce(F.is_variant_null(held), F.lit(False)) & ~false

    def _range(self, value: object) -> Column:
        parts = _members(value, "range", {"field", "unit"}, {"gt", "gte", "lt", "lte"})
        if not _named(parts["unit"]):
            raise FilterRefused("validation_error", "range")
        _field(parts["field"])
        sides = [[parts[k] for k in pair if k in parts] for pair in (("gt", "gte"), ("lt", "lte"))]
        numeric = all(isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) for side in sides for v in side)
        if [len(s) for s in sides] != [1, 1] or not numeric:
            raise FilterRefused("validation_error", "bounds")
        raise FilterRefused("unsupported_filter", "unit")

    def _relation(self, value: object) -> Column:
        parts = _members(value, "relation", {"relation_type", "direction"}, {"artifact_id"})
        if not _named(parts["relation_type"]) or parts["direction"] not in ("outbound", "inbound") or not _named(parts.get("artifact_id", "-")):
            raise FilterRefused("validation_error", "relation")
        raise FilterRefused("unsupported_relation", "no_relation")
