"""Dictionary-specified queries: filter, projection, sort, skip and limit as one lazy DataFrame."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from datetime import date, datetime
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_LIMIT = 1000


def _type_at(schema: T.StructType, path: str) -> T.DataType | None:
    """The type of what a path leads to; an array of it where the path goes through an array."""
    kind: T.DataType | None = schema
    many = False
    for part in path.split("."):
        if isinstance(kind, T.ArrayType):
            kind, many = kind.elementType, True
        kind = next((f.dataType for f in kind if f.name == part), None) if isinstance(kind, T.StructType) else None
    return T.ArrayType(kind.elementType if isinstance(kind, T.ArrayType) else kind) if many and kind is not None else kind


def _field(name: str):
    return lambda x: x.getField(name)


def _value_at(schema: T.StructType, path: str) -> Column:
    """What a path leads to; through arrays of objects, the values of all elements in one array."""
    parts = path.split(".")
    if parts[0] not in schema.names:
        return F.col(path)
    value, kind, many = F.col(f"`{parts[0]}`"), schema[parts[0]].dataType, False
    for part in parts[1:]:
        if isinstance(kind, T.ArrayType) and not many:
            many, kind = True, kind.elementType
        elif isinstance(kind, T.ArrayType):
            value, kind = F.flatten(value), kind.elementType
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return F.col(path)
        value = F.transform(value, _field(part)) if many else value.getField(part)
        kind = kind[part].dataType
    return F.flatten(F.filter(value, lambda x: x.isNotNull())) if many and isinstance(kind, T.ArrayType) else value


def _literal(value: Any) -> Column:
    if isinstance(value, Mapping) and set(value) == {"$date"}:
        return F.to_timestamp(F.lit(value["$date"]))
    if isinstance(value, (datetime, date)):
        return F.lit(value)
    if isinstance(value, (list, tuple)):
        return F.array(*map(_literal, value))
    return F.lit(value)


def _compare(c: Column, kind: T.DataType | None, op: str, value: Any, options: str = "") -> Column:
    in_array = isinstance(kind, T.ArrayType)
    any_of = lambda test: F.exists(c, test) if in_array and not isinstance(value, (list, tuple)) else test(c)
    match op:
        case "$eq":
            return c.isNull() if value is None else any_of(lambda x: x == _literal(value))
        case "$ne":
            return c.isNotNull() if value is None else ~F.coalesce(any_of(lambda x: x == _literal(value)), F.lit(False))
        case "$gt":
            return any_of(lambda x: x > _literal(value))
        case "$gte":
            return any_of(lambda x: x >= _literal(value))
        case "$lt":
            return any_of(lambda x: x < _literal(value))
        case "$lte":
            return any_of(lambda x: x <= _literal(value))
        case "$in" | "$nin":
            listed = [v for v in value if v is not None]
            test = lambda x: x.isin(*map(_literal, listed)) if listed else F.lit(False)
            found = F.exists(c, test) if in_array else test(c)
            found = F.coalesce(found, F.lit(False)) | (c.isNull() if None in value else F.lit(False))
            return found if op == "$in" else ~found
        case "$exists":
            return c.isNotNull() if value else c.isNull()
        case "$regex":
            return any_of(lambda x: x.rlike(("(?i)" if "i" in options else "") + value))
        case "$size":
            return F.size(c) == F.lit(value)
        case "$all":
            return reduce(and_, [F.array_contains(c, _literal(v)) for v in value], F.lit(True))
        case "$elemMatch":
            inner = kind.elementType if isinstance(kind, T.ArrayType) else None
            if any(k.startswith("$") for k in value):
                return F.exists(c, lambda x: reduce(and_, [_compare(x, inner, k, v) for k, v in value.items()]))
            return F.exists(c, lambda x: reduce(and_, [_clause(x.getField(k), _type_at(inner, k) if isinstance(inner, T.StructType) else None, v) for k, v in value.items()]))
        case "$not":
            return ~F.coalesce(_clause(c, kind, value), F.lit(False))
    raise ValueError(f"unknown operator: {op}")


def _clause(c: Column, kind: T.DataType | None, value: Any) -> Column:
    if isinstance(value, Mapping) and set(value) != {"$date"} and any(k.startswith("$") for k in value):
        ops = {k: v for k, v in value.items() if k != "$options"}
        return reduce(and_, [_compare(c, kind, op, v, value.get("$options", "")) for op, v in ops.items()])
    return _compare(c, kind, "$eq", value)


def condition(df: DataFrame, spec: Mapping[str, Any]) -> Column:
    """A filter document as one Column; clauses are ANDed, unknown operators raise."""
    parts: list[Column] = []
    for key, value in spec.items():
        if key in ("$and", "$or", "$nor"):
            joined = reduce(and_ if key == "$and" else or_, [condition(df, v) for v in value])
            parts.append(~F.coalesce(joined, F.lit(False)) if key == "$nor" else joined)
        elif key.startswith("$"):
            raise ValueError(f"unknown operator: {key}")
        else:
            parts.append(_clause(_value_at(df.schema, key), _type_at(df.schema, key), value))
    return reduce(and_, parts, F.lit(True))


def parsed(spec: str | Mapping[str, Any]) -> dict[str, Any]:
    """A spec given as text or mapping; text that isn't a JSON object raises."""
    if isinstance(spec, str):
        spec = json.loads(spec)
    if not isinstance(spec, Mapping):
        raise ValueError("a query must be an object")
    return dict(spec)


def renamed(spec: Any, names: Mapping[str, str]) -> Any:
    """The spec with every part of every path put through ``names``, at any depth."""
    if isinstance(spec, Mapping):
        return {k if k.startswith("$") else ".".join(names.get(x, x) for x in k.split(".")): renamed(v, names) for k, v in spec.items()}
    return [renamed(v, names) for v in spec] if isinstance(spec, list) else spec


def project(df: DataFrame, spec: Mapping[str, Any], key: str | None = None) -> DataFrame:
    """Inclusion (1), exclusion (0) or renaming (``"$path"``); the key stays unless excluded; mixing raises."""
    if not spec:
        return df
    named = {k: v for k, v in spec.items() if isinstance(v, str)}
    flags = {k: bool(v) for k, v in spec.items() if not isinstance(v, str) and k != key}
    if len(set(flags.values())) > 1 or (named and False in flags.values()):
        raise ValueError("a projection either includes or excludes")
    if named or True in flags.values():
        keep = [key] if key and spec.get(key, 1) not in (0, False) and key not in flags else []
        nested = [p for p in flags if "." in p]
        out = [F.col(k) for k in keep] + [F.col(p) for p in flags if "." not in p]
        for root in dict.fromkeys(p.split(".")[0] for p in nested):
            out.append(_keep(F.col(root), df.schema[root].dataType, [p.split(".", 1)[1] for p in nested if p.split(".")[0] == root]).alias(root))
        return df.select(*out, *[F.col(v.removeprefix("$")).alias(k) for k, v in named.items()])
    drops = [k for k, v in spec.items() if not v]
    for path in drops:
        root, _, rest = path.partition(".")
        df = df.withColumn(root, F.col(root).dropFields(rest)) if rest else df.drop(root)
    return df


def _keep(c: Column, kind: T.DataType, paths: list[str]) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _keep(x, kind.elementType, paths)) if isinstance(kind.elementType, T.StructType) else c
    if not isinstance(kind, T.StructType) or not paths:
        return c
    fields = []
    for f in kind:
        below = [p.partition(".")[2] for p in paths if p.split(".")[0] == f.name]
        if below:
            fields.append((c.getField(f.name) if "" in below else _keep(c.getField(f.name), f.dataType, below)).alias(f.name))
    return F.when(c.isNotNull(), F.struct(*fields)) if fields else c


def keep_paths(df: DataFrame, paths: str) -> DataFrame:
    """Only the comma-listed dotted paths, through objects and arrays of objects; absent ones are skipped."""
    wanted = [p.strip() for p in paths.split(",")]
    roots = [c for c in df.columns if any(p.split(".")[0] == c for p in wanted)]
    return df.select(*[_keep(F.col(c), df.schema[c].dataType, [] if c in wanted else [p.split(".", 1)[1] for p in wanted if p.startswith(c + ".")]).alias(c) for c in roots])


def ordered(df: DataFrame, sort: Mapping[str, int] | None, tiebreak: str | None = None) -> DataFrame:
    keys = [F.col(k).asc() if way > 0 else F.col(k).desc() for k, way in (sort or {}).items()]
    return df.orderBy(*keys, *([tiebreak] if tiebreak and tiebreak not in (sort or {}) else [])) if keys or tiebreak else df


def _first_matches(df: DataFrame, condition_of: Mapping[str, Any], name: str) -> Column:
    """The first element of an array of objects that meets what the filter asks of its elements, in an array; null if it asks nothing or none does."""
    asked = {k[len(name) + 1 :]: v for k, v in condition_of.items() if k.startswith(name + ".")}
    more = condition_of.get(name)
    asked |= more["$elemMatch"] if isinstance(more, Mapping) and isinstance(more.get("$elemMatch"), Mapping) else {}
    kind = _type_at(df.schema, name)
    if not asked or not isinstance(kind, T.ArrayType):
        return F.lit(None).cast(kind or "string")
    hits = F.filter(F.col(name), lambda x: reduce(and_, [_clause(x.getField(k), _type_at(kind.elementType, k), v) for k, v in asked.items()]))
    return F.when(F.size(hits) > 0, F.slice(hits, 1, 1))


def find(df: DataFrame, spec: str | Mapping[str, Any], key: str | None = None, names: Mapping[str, str] | None = None, stages: Sequence[Callable[[DataFrame], DataFrame]] = ()) -> DataFrame:
    """``{filter, projection, sort, skip, limit}``; limit is 1000 unless given, 0 means none.

    ``stages`` are functions from frame to frame that run between the filter and the sort. A projected ``path.$`` is the
    first element of the array that the filter's conditions on it are met by.
    """
    q = renamed(parsed(spec), names or {})
    out = df.filter(condition(df, q.get("filter") or {}))
    projection = dict(q.get("projection") or {})
    for path in [p for p in projection if p.endswith(".$") and "." not in p[:-2]]:
        out = out.withColumn(path[:-2], _first_matches(df, q.get("filter") or {}, path[:-2]))
        projection[path[:-2]] = projection.pop(path)
    for stage in stages:
        out = out.transform(stage)
    out = ordered(out, q.get("sort"), key if q.get("sort") else None)
    if q.get("skip"):
        out = out.offset(int(q["skip"]))
    limit = int(q.get("limit", DEFAULT_LIMIT))
    return project(out.limit(limit) if limit else out, projection, key)


def _leaves(probe: Mapping[str, Any], at: str = "") -> dict[str, Any]:
    out: dict[str, Any] = {}
    for k, v in probe.items():
        out |= _leaves(v, f"{at}{k}.") if isinstance(v, Mapping) else {at + k: v} if v is not None else {}
    return out


def by_example(df: DataFrame, probe: Mapping[str, Any]) -> DataFrame:
    """Rows equal to the probe's non-null leaves."""
    return df.filter(condition(df, _leaves(probe)))


def page(df: DataFrame, number: int = 0, size: int = 10, key: str | None = None) -> DataFrame:
    """One page without counting; give a key for a stable order."""
    out = df.orderBy(key) if key else df
    return out.offset(number * size).limit(size)


def by_id(df: DataFrame, key: str, value: Any) -> DataFrame:
    return df.filter(F.col(key) == F.lit(value))


def embedded_by_id(df: DataFrame, path: str, id_field: str, value: Any) -> DataFrame:
    """The first embedded object at ``path`` whose own id is ``value``, as a row of its own; none without a match."""
    return df.filter(F.col(f"{path}.{id_field}") == F.lit(value)).limit(1).select(f"{path}.*")


def grid_view(df: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """Label -> dotted path; arrays are joined with commas skipping nulls, ``a.$`` takes the first, midnight times are cut."""
    out = []
    for label, path in fields.items():
        if path.endswith(".$"):
            c = F.get(F.col(path[:-2]), F.lit(0))
            out.append((F.to_json(c) if isinstance(_type_at(df.schema, path[:-2]), T.StructType) else c.cast("string")).alias(label))
            continue
        c, kind = F.col(path), df.select(F.col(path)).schema[0].dataType
        if isinstance(kind, T.ArrayType):
            out.append(F.array_join(F.filter(F.transform(c, lambda x: x.cast("string")), lambda x: x.isNotNull() & (x != "")), ",").alias(label))
        else:
            out.append(F.regexp_replace(c.cast("string"), "[ T]00:00:00(Z|\\+00:00)?$", "").alias(label))
    return df.select(*out)


def first_match(array: str, test) -> Column:
    """Only the element of an array that a filter matched."""
    return F.get(F.filter(F.col(array), test), F.lit(0))


def increment(df: DataFrame, key: str, value: Any, field: str, by: Any) -> DataFrame:
    return df.withColumn(field, F.when(F.col(key) == F.lit(value), F.col(field) + F.lit(by)).otherwise(F.col(field)))
