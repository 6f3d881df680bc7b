"""Schemas as YAML and as Python source, back from both, and the checks from text to a live atlas."""

from __future__ import annotations

import ast
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiltframe import schema as S
from quiltframe import schema_ir as IR
from quiltframe.functions.ids import stable_uid


# YAML: the part that schemas need, block mappings and lists of scalars; anything JSON is YAML too

def _scalar(text: str) -> object:
    text = text.strip()
    if text in ("", "~", "null"):
        return None
    if text in ("true", "false"):
        return text == "true"
    if text[0] in "[{\"":
        try:
            return json.loads(text)
        except ValueError:
            inner = text[1:-1].strip()
            if text[0] == "[":
                return [_scalar(x) for x in inner.split(",")] if inner else []
            return {k.strip(): _scalar(v) for k, _, v in (x.partition(":") for x in inner.split(","))} if inner else {}
    if text[0] == "'" and text[-1] == "'":
        return text[1:-1].replace("''", "'")
    try:
        return int(text)
    except ValueError:
        return text


def from_yaml(text: str) -> object:
    """Mappings, lists and scalars by indentation; tabs, anchors and repeated keys are refused."""
    if text.lstrip().startswith("{"):
        return json.loads(text)
    lines = []
    for n, raw in enumerate(text.split("\n"), 1):
        body = raw.split(" #")[0].rstrip() if not raw.lstrip().startswith("#") else ""
        if body.strip() and body.strip() != "---":
            if "\t" in body[: len(body) - len(body.lstrip())] or body.lstrip()[0] in "&*":
                raise ValueError(f"line {n}: tabs and anchors are not read")
            lines.append((len(body) - len(body.lstrip()), body.strip(), n))

    def block(at: int, depth: int) -> tuple[object, int]:
        if lines[at][1].startswith("- ") or lines[at][1] == "-":
            out: list = []
            while at < len(lines) and lines[at][0] == depth and lines[at][1].startswith("-"):
                rest = lines[at][1][1:].strip()
                if rest:
                    out.append(_scalar(rest))
                    at += 1
                else:
                    value, at = block(at + 1, lines[at + 1][0])
                    out.append(value)
            return out, at
        found: dict = {}
        while at < len(lines) and lines[at][0] == depth:
            key, colon, rest = lines[at][1].partition(":")
            key = key.strip().strip("'\"")
            if not colon or key in found:
                raise ValueError(f"line {lines[at][2]}: no key, or one that is there already")
            if rest.strip():
                found[key], at = _scalar(rest), at + 1
            elif at + 1 < len(lines) and (lines[at + 1][0] > depth or (lines[at + 1][0] == depth and lines[at + 1][1].startswith("-"))):
                found[key], at = block(at + 1, lines[at + 1][0])
            else:
                found[key], at = None, at + 1
        if at < len(lines) and lines[at][0] > depth:
            raise ValueError(f"line {lines[at][2]}: of another indentation")
        return found, at

    if not lines:
        return {}
    value, at = block(0, lines[0][0])
    if at < len(lines):
        raise ValueError(f"line {lines[at][2]}: of another indentation")
    return value


def to_yaml(value: object, depth: int = 0) -> str:
    pad = "  " * depth
    if isinstance(value, dict) and value:
        return "".join(f"{pad}{k}:\n{to_yaml(v, depth + 1)}" if isinstance(v, dict) and v else f"{pad}{k}: {json.dumps(v)}\n" for k, v in value.items())
    return f"{pad}{json.dumps(value)}\n"


# Python source

def source(tables: dict[str, T.StructType], constraints: dict[str, dict] | None = None) -> str:
    """Python that builds the tables, one call for each; what :func:`from_source` reads."""
    out = ['"""Table schemas, generated."""', "", "from quiltframe.schema_code import column, table", ""]
    for name, t in IR.dump(tables, constraints)["tables"].items():
        out.append(f"{name} = table(")
        out.append(f"    {name!r},")
        for f, spec in t["fields"].items():
            out.append(f"    column({f!r}, {', '.join(f'{k}={v!r}' for k, v in spec.items())}),")
        for k in ("require_any", "equal_length"):
            if k in t:
                out.append(f"    {k}={t[k]!r},")
        out += [")", ""]
    return "\n".join(out)


def column(name: str, **spec: object) -> tuple[str, dict]:
    return name, spec


def table(name: str, *columns: tuple[str, dict], **constraints: object) -> tuple[str, dict]:
    return name, {"fields": dict(columns)} | constraints


def from_source(text: str) -> dict:
    """The dictionary form of a generated module, read without running it; anything but its calls is refused."""
    tables = {}
    for node in ast.parse(text).body:
        if isinstance(node, (ast.ImportFrom, ast.Import)) or (isinstance(node, ast.Expr) and isinstance(node.value, ast.Constant)):
            continue
        call = node.value if isinstance(node, ast.Assign) else None
        if not (isinstance(call, ast.Call) and isinstance(call.func, ast.Name) and call.func.id == "table"):
            raise ValueError(f"line {node.lineno}: not a table")
        name = ast.literal_eval(call.args[0])
        fields = {}
        for c in call.args[1:]:
            if not (isinstance(c, ast.Call) and isinstance(c.func, ast.Name) and c.func.id == "column"):
                raise ValueError(f"line {c.lineno}: not a column")
            fields[ast.literal_eval(c.args[0])] = {k.arg: ast.literal_eval(k.value) for k in c.keywords}
        tables[name] = {"fields": fields} | {k.arg: ast.literal_eval(k.value) for k in call.keywords}
    return {"tables": tables}


# for visualisers and curation

@dataclass
class Parsed:
    tables: dict[str, list[dict]]
    relationships: list[dict]
    inherited: dict[str, list[str]] = field(default_factory=dict)


def parsed(tables: dict[str, T.StructType], parents: dict[str, str] | None = None) -> Parsed:
    """Fields, and foreign keys with whether they are lists; with parents, what a table has from another."""
    rows = {n: [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable, "pointer": S.pointer_kind(f.dataType), **{k: v for k, v in f.metadata.items() if k != "feature_space"}} for f in t.fields] for n, t in tables.items()}
    links = [{"from": n, "column": c, "to": to, "many": isinstance(tables[n][c].dataType, T.ArrayType)} for n, c, to in IR.relationships(tables)]
    inherited = {n: [f.name for f in tables[n].fields if f.name in tables[p].fieldNames()] for n, p in (parents or {}).items()}
    return Parsed(rows, links, inherited)


def markers(schema: T.StructType, name: str) -> dict[str, object]:
    """The columns that have a marker, with what it says."""
    return {f.name: f.metadata[name] for f in schema.fields if f.metadata.get(name)}


def deferred(schema: T.StructType) -> set[str]:
    """What is filled in after curation: pointers, presence and summaries."""
    return {f.name for f in schema.fields if S.pointer_kind(f.dataType) or f.metadata.get("summary") or f.name.startswith("has_")}


# rows

def check_records(df: DataFrame, schema: T.StructType, new: bool = True) -> list[str]:
    """What is wrong with rows: uids that differ from the stable uid of their source, numbers given at creation, corners in the wrong order."""
    tests: dict[str, Column] = {}
    for f in schema.fields:
        if f.metadata.get("stable_uid") and "uid" in df.columns and f.name in df.columns:
            tests[f"uid is not that of {f.name}"] = F.col(f.name).isNotNull() & ~F.col("uid").eqNullSafe(stable_uid(F.col(f.name)))
        if S.pointer_kind(f.dataType) == "spatial" and f.name in df.columns:
            lo, hi = F.col(f"{f.name}.min_corner"), F.col(f"{f.name}.max_corner")
            tests[f"{f.name}: corners"] = (F.size(lo) != F.size(hi)) | F.exists(F.zip_with(lo, hi, lambda a, b: ~(a < b)), lambda x: F.coalesce(x, F.lit(True)))
    if new and "global_index" in df.columns:
        tests["global_index is given"] = F.col("global_index").isNotNull()
    if not tests:
        return []
    n = df.agg(*[F.count_if(F.coalesce(t, F.lit(False))).alias(f"t{i}") for i, t in enumerate(tests.values())]).first()
    return [f"{what}: {n[f't{i}']} rows" for i, what in enumerate(tests) if n[f"t{i}"]]


def pointer_struct(kind: str, **columns: str) -> Column:
    """A pointer of columns, in its fields' order and types; all null columns make a null pointer."""
    want = S.POINTERS[kind]
    if missing := set(want.fieldNames()) - set(columns):
        raise ValueError(f"a {kind} pointer needs {sorted(missing)}")
    made = F.struct(*[F.col(columns[f.name]).cast(f.dataType).alias(f.name) for f in want.fields])
    return F.when(F.col(columns["zarr_group"]).isNotNull(), made)


def prepared(df: DataFrame, *columns: str) -> DataFrame:
    """df, if an earlier step has made the columns."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"prepare the rows first: no {missing}")
    return df


def validate(text: str, spark: SparkSession, root: str) -> list[tuple[str, str | None]]:
    """The stages from a schema's text to a live atlas, each with its fault or None; the first fault ends it."""
    from quiltframe.sources.atlas import Atlas

    state: dict = {}

    def parse() -> None:
        state["ir"] = from_yaml(text)

    def load() -> None:
        state["tables"], state["constraints"] = IR.load(state["ir"])

    def generate() -> None:
        back = from_source(source(state["tables"], state["constraints"]))
        if IR.dump(*IR.load(back)) != IR.dump(state["tables"], state["constraints"]):
            raise ValueError("the generated source gives another schema")

    def split() -> None:
        state["obs"] = {n: t for n, t in state["tables"].items() if any(S.pointer_kind(f.dataType) for f in t.fields)}
        if not state["obs"]:
            raise ValueError("no table has a pointer")
        for t in state["obs"].values():
            S.check_obs(t)

    def live() -> None:
        spaces = {s for t in state["obs"].values() for s in S.pointers(t).values()}
        features = {s: state["tables"].get(s, T.StructType([])) for s in spaces if S.SPACES[s].has_features}
        Atlas.create(spark, root, state["obs"], features, {n: t for n, t in state["tables"].items() if n not in state["obs"] and n not in features})

    out: list[tuple[str, str | None]] = []
    stages: dict[str, Callable[[], None]] = {"parse": parse, "load": load, "generate": generate, "obs tables": split, "atlas": live}
    for name, run in stages.items():
        try:
            run()
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            return [*out, (name, f"{type(e).__name__}: {e}")]
        out.append((name, None))
    return out
