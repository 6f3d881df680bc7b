"""Audited column edits and reshapes."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _value(value: object, kind: str | None = None, expr: bool = False) -> Column:
    c = F.expr(str(value)) if expr else F.lit(value)
    return c.cast(kind) if kind else c


@dataclass(frozen=True)
class Op:
    """One edit; check sees the columns before it and gives those after it."""

    def check(self, columns: dict[str, str]) -> dict[str, str]:
        return columns

    def apply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    @staticmethod
    def _need(columns: dict[str, str], *names: str) -> None:
        if missing := [n for n in names if n not in columns]:
            raise ValueError(f"no column {missing}")

    @staticmethod
    def _new(columns: dict[str, str], *names: str) -> None:
        if there := [n for n in names if n in columns]:
            raise ValueError(f"column {there} is there already")


@dataclass(frozen=True)
class ReplaceValue(Op):
    column: str
    old: object
    new: object

    def check(self, columns):
        self._need(columns, self.column)
        return columns

    def apply(self, df):
        kind = dict(df.dtypes)[self.column]
        return df.withColumn(self.column, F.when(F.col(self.column).eqNullSafe(F.lit(self.old).cast(kind)), F.lit(self.new).cast(kind)).otherwise(F.col(self.column)))


@dataclass(frozen=True)
class SetColumn(Op):
    column: str
    value: object = None
    expr: bool = False

    def check(self, columns):
        self._need(columns, self.column)
        return columns

    def apply(self, df):
        return df.withColumn(self.column, _value(self.value, dict(df.dtypes)[self.column], self.expr))


@dataclass(frozen=True)
class AddColumn(Op):
    column: str
    value: object = None
    kind: str | None = None
    expr: bool = False

    def check(self, columns):
        self._new(columns, self.column)
        return columns | {self.column: self.kind or "?"}

    def apply(self, df):
        return df.withColumn(self.column, _value(self.value, self.kind, self.expr))


@dataclass(frozen=True)
class RenameColumn(Op):
    column: str
    to: str

    def check(self, columns):
        self._need(columns, self.column)
        self._new(columns, self.to)
        return {self.to if k == self.column else k: v for k, v in columns.items()}

    def apply(self, df):
        return df.withColumnRenamed(self.column, self.to)


@dataclass(frozen=True)
class DropColumn(Op):
    column: str

    def check(self, columns):
        self._need(columns, self.column)
        return {k: v for k, v in columns.items() if k != self.column}

    def apply(self, df):
        return df.drop(self.column)


@dataclass(frozen=True)
class CastColumn(Op):
    """The column goes last, as a rewritten one does."""

    column: str
    kind: str

    def check(self, columns):
        self._need(columns, self.column)
        return {k: v for k, v in columns.items() if k != self.column} | {self.column: self.kind}

    def apply(self, df):
        return df.select(*[c for c in df.columns if c != self.column], F.col(self.column).cast(self.kind).alias(self.column))


@dataclass(frozen=True)
class MergeColumns(Op):
    """Columns of source replace those of rows with the same key; unmatched rows stay. Keys of source are unique."""

    key: str
    columns: tuple[str, ...]
    source: DataFrame = field(repr=False, compare=False)

    def check(self, columns):
        self._need(columns, self.key, *self.columns)
        if self.source.groupBy(self.key).count().where("count > 1").take(1):
            raise ValueError(f"keys {self.key!r} of the source are not unique")
        return columns

    def apply(self, df):
        s = self.source.select(F.col(self.key).alias("__k"), F.struct(*self.columns).alias("__s"))
        kinds = dict(df.dtypes)
        return df.join(s, F.col(self.key) == F.col("__k"), "left").select(*[(F.when(F.col("__k").isNotNull(), F.col(f"__s.{c}").cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in self.columns else F.col(c)) for c in df.columns])


@dataclass(frozen=True)
class ExplodeColumn(Op):
    """A row for each part of a text column split by a pattern; a null cell is one row at position 0."""

    column: str
    pattern: str
    position: str | None = None
    drop_empty: bool = True

    def check(self, columns):
        self._need(columns, self.column)
        if self.position:
            self._new(columns, self.position)
        return columns | ({self.position: "int"} if self.position else {})

    def apply(self, df):
        c = F.col(self.column)
        parts = F.transform(F.split(c, self.pattern), lambda x: F.trim(x)) if dict(df.dtypes)[self.column] == "string" else F.array(c)
        if self.drop_empty and dict(df.dtypes)[self.column] == "string":
            parts = F.filter(parts, lambda x: x != "")
        out = df.select(*df.columns, F.posexplode_outer(parts).alias("__p", "__v"))
        pos = F.when(c.isNull(), 0).otherwise(F.col("__p"))
        kept = [F.col("__v").alias(x) if x == self.column else F.col(x) for x in df.columns]
        return out.select(*kept, *([pos.alias(self.position)] if self.position else []))


@dataclass(frozen=True)
class WideToLong(Op):
    """Parallel families of columns become rows: slot label -> {output column: input column}. Slots without any value are dropped."""

    slot: str
    slots: dict[str, dict[str, str]]
    drop_null: bool = True

    def check(self, columns):
        used = [c for m in self.slots.values() for c in m.values()]
        self._need(columns, *used)
        rest = {k: v for k, v in columns.items() if k not in used}
        outs = list(next(iter(self.slots.values())))
        self._new(rest, self.slot, *outs)
        return rest | {self.slot: "string"} | {o: columns[next(iter(self.slots.values()))[o]] for o in outs}

    def apply(self, df):
        used = {c for m in self.slots.values() for c in m.values()}
        outs = list(next(iter(self.slots.values())))
        made = F.array(*[F.struct(F.lit(label).alias(self.slot), *[F.col(m[o]).alias(o) for o in outs]) for label, m in self.slots.items()])
        out = df.select(*[c for c in df.columns if c not in used], F.inline(made))
        return out.where(" or ".join(f"`{o}` is not null" for o in outs)) if self.drop_null else out


@dataclass
class Transaction:
    """Edits of one table in order, with who made them and why."""

    table: str
    ops: list[Op]
    tool: str = ""
    reason: str = ""
    uid: str = field(default_factory=lambda: uuid.uuid4().hex[:16])


class Audit:
    """Append-only records of transactions and their changes, newest first when listed."""

    def __init__(self) -> None:
        self.transactions: list[dict] = []
        self.changes: list[dict] = []

    def begin(self, t: Transaction, version: int | None) -> dict:
        row = {"uid": t.uid, "table": t.table, "tool": t.tool, "reason": t.reason, "status": "pending", "error": None, "before": version, "at": time.time()}
        self.transactions.append(row)
        self.changes += [{"transaction": t.uid, "order": i, "op": type(o).__name__, "payload": json.dumps({k: v for k, v in asdict_plain(o).items()}, default=str), "status": "pending"} for i, o in enumerate(t.ops)]
        return row

    def list(self, table: str | None = None, limit: int | None = None) -> list[dict]:
        got = [t for t in reversed(self.transactions) if table in (None, t["table"])]
        return got[:limit]

    def get(self, uid: str) -> list[dict]:
        return sorted((c for c in self.changes if c["transaction"] == uid), key=lambda c: c["order"])

    def version_before(self, uid: str) -> int | None:
        return next(t["before"] for t in self.transactions if t["uid"] == uid)


def asdict_plain(o: Op) -> dict:
    return {k: v for k, v in o.__dict__.items() if not isinstance(v, DataFrame)}


def apply(df: DataFrame, t: Transaction, audit: Audit | None = None, version: int | None = None, allowed: set[str] | None = None, dry_run: bool = False, commit: Callable[[DataFrame], None] | None = None) -> tuple[DataFrame, str]:
    """The table after a transaction and its status: validated, applied, partial or failed.

    All edits are checked against the columns as they would be before any is
    applied. When one fails, those before it stay (partial) and the audit keeps
    the error. commit is called after each and runs it; without, an edit is
    only planned, and faults in the rows show where the result is used.
    """
    columns = dict(df.dtypes)
    for op in t.ops:
        column = getattr(op, "column", None)
        if allowed is not None and column is not None and column not in allowed and not isinstance(op, DropColumn):
            raise ValueError(f"column {column!r} may not be edited")
        columns = op.check(columns)
    if dry_run:
        return df, "validated"
    row = audit.begin(t, version) if audit else {}
    done = 0
    try:
        for op in t.ops:
            df = op.apply(df)
            df.schema  # noqa: B018  analysis errors show here
            if commit:
                commit(df)
            done += 1
        row["status"] = "applied"
    except (PySparkException, ValueError, KeyError, TypeError) as e:
        row["status"] = "partial" if done else "failed"
        row["error"] = f"{type(e).__name__}: {e}"[:2_000]
    if audit:
        for c in audit.get(t.uid)[:done]:
            c["status"] = "applied"
    return df, row.get("status", "applied" if done == len(t.ops) else "partial")
