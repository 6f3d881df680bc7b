"""Schemas as plain dictionaries (JSON or YAML), and back."""

from __future__ import annotations

import json

from pyspark.sql import types as T

from quiltframe import schema as S

KINDS = {"string": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "datetime": T.TimestampType()}
MARKERS = ("stable_uid", "registry_key", "polymorphic_registry_key", "ontology_aligned", "cross_reference", "summary", "enum", "natural_key")
TABLE_KEYS = {"fields", "require_any", "equal_length"}


def _strict(where: str, given: dict, known: set[str]) -> None:
    if unknown := set(given) - known:
        raise ValueError(f"{where} has unknown keys {sorted(unknown)}")


def load(ir: dict | str) -> tuple[dict[str, T.StructType], dict[str, dict]]:
    """Table schemas, and constraints by table. Unknown keys, kinds and tables referred to are errors."""
    ir = json.loads(ir) if isinstance(ir, str) else ir
    _strict("the schema", ir, {"tables", "enums"})
    enums = ir.get("enums", {})
    tables, constraints = {}, {}
    for name, t in ir["tables"].items():
        _strict(name, t, TABLE_KEYS)
        fields = []
        for f, spec in t["fields"].items():
            _strict(f"{name}.{f}", spec, {"kind", "list", "nullable", "pointer", *MARKERS})
            if "pointer" in spec:
                fields.append(S.pointer(f, spec["pointer"], spec.get("nullable", True)))
                continue
            kind = "string" if "enum" in spec else spec["kind"]
            if kind not in KINDS or ("enum" in spec and spec["enum"] not in enums):
                raise ValueError(f"{name}.{f} has an unknown kind")
            what = T.ArrayType(KINDS[kind]) if spec.get("list") else KINDS[kind]
            fields.append(T.StructField(f, what, spec.get("nullable", True), {k: spec[k] for k in MARKERS if k in spec}))
        tables[name] = T.StructType(fields)
        if sum(bool(f.metadata.get("stable_uid")) for f in fields) > 1:
            raise ValueError(f"{name} has more than one stable uid")
        constraints[name] = {k: t[k] for k in ("require_any", "equal_length") if k in t}
    for name, schema in tables.items():
        for f in schema.fields:
            for to in _targets(f):
                if to not in tables:
                    raise ValueError(f"{name}.{f.name} refers to no table {to!r}")
    return tables, constraints


def _targets(f: T.StructField) -> list[str]:
    one = f.metadata.get("registry_key")
    return ([one] if one else []) + list((f.metadata.get("polymorphic_registry_key") or {}).values())


def dump(tables: dict[str, T.StructType], constraints: dict[str, dict] | None = None) -> dict:
    back = {v: k for k, v in KINDS.items()}
    out = {}
    for name, schema in tables.items():
        fields = {}
        for f in schema.fields:
            if S.pointer_kind(f.dataType):
                fields[f.name] = {"pointer": f.metadata["feature_space"]}
            else:
                item = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
                fields[f.name] = {"kind": back[item]} | ({"list": True} if item is not f.dataType else {}) | {k: f.metadata[k] for k in MARKERS if k in f.metadata and k != "enum"}
            if not f.nullable:
                fields[f.name]["nullable"] = False
        out[name] = {"fields": fields} | (constraints or {}).get(name, {})
    return {"tables": out}


def relationships(tables: dict[str, T.StructType]) -> list[tuple[str, str, str]]:
    """(table, column, table referred to) of every foreign key."""
    return [(n, f.name, to) for n, s in tables.items() for f in s.fields for to in _targets(f)]
