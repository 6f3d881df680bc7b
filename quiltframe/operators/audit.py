"""Audit of curation in tables of a store: append-only, so every state can be read again."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiltframe.operators import curation
from quiltframe.sources.store import Store

TRANSACTIONS = T.StructType([T.StructField(n, T.StringType()) for n in ("uid", "table", "tool", "reason", "status", "error")] + [T.StructField("before", T.LongType()), T.StructField("at", T.DoubleType())])
CHANGES = T.StructType([T.StructField("transaction", T.StringType()), T.StructField("order", T.LongType()), T.StructField("op", T.StringType()), T.StructField("payload", T.StringType()), T.StructField("status", T.StringType()), T.StructField("at", T.DoubleType())])


def op_to_json(op: curation.Op) -> tuple[str, str]:
    """An edit's kind and its fields; tables that an edit brings along are not kept."""
    return type(op).__name__, json.dumps(curation.asdict_plain(op), default=list)


def op_from_json(kind: str, payload: str) -> curation.Op:
    made = getattr(curation, kind, None)
    if not (isinstance(made, type) and issubclass(made, curation.Op)):
        raise ValueError(f"no such edit: {kind!r}")
    return made(**json.loads(payload))


class AuditStore:
    """Transactions and their changes. A change of status is a row more; the newest counts."""

    def __init__(self, store: Store):
        self.store = store
        for name, schema in (("audit.transactions", TRANSACTIONS), ("audit.changes", CHANGES)):
            if store.version(name) < 0:
                store.create(name, schema)

    def _add(self, name: str, rows: list[tuple], schema: T.StructType) -> None:
        self.store.append(name, self.store.spark.createDataFrame(rows, schema))

    def begin(self, t: curation.Transaction, version: int | None) -> None:
        self._add("audit.transactions", [(t.uid, t.table, t.tool, t.reason, "pending", None, version, time.time())], TRANSACTIONS)
        if t.ops:
            self._add("audit.changes", [(t.uid, i, *op_to_json(o), "pending", time.time()) for i, o in enumerate(t.ops)], CHANGES)

    def finish(self, t: curation.Transaction, version: int | None, status: str, done: int, error: str | None = None) -> None:
        self._add("audit.transactions", [(t.uid, t.table, t.tool, t.reason, status, error, version, time.time())], TRANSACTIONS)
        if done:
            self._add("audit.changes", [(t.uid, i, *op_to_json(o), "applied", time.time()) for i, o in enumerate(t.ops[:done])], CHANGES)

    def _newest(self, name: str, *key: str) -> DataFrame:
        w = Window.partitionBy(*key).orderBy(F.desc("at"))
        return self.store.read(name).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")

    def list(self, table: str | None = None, limit: int | None = None) -> DataFrame:
        """Transactions, newest first."""
        out = self._newest("audit.transactions", "uid")
        out = out.where(F.col("table") == table) if table is not None else out
        out = out.orderBy(F.desc("at"), "uid")
        return out.limit(limit) if limit is not None else out

    def get(self, uid: str) -> DataFrame:
        """The changes of a transaction in their order."""
        return self._newest("audit.changes", "transaction", "order").where(F.col("transaction") == uid).orderBy("order")

    def pending(self, uid: str) -> list[curation.Op]:
        """The edits of a transaction that were not applied, to be tried again."""
        return [op_from_json(r.op, r.payload) for r in self.get(uid).where("status = 'pending'").collect()]

    def version_before(self, uid: str) -> int:
        got = self.store.read("audit.transactions").where(F.col("uid") == uid).agg(F.min_by("before", "at").alias("v")).first().v
        if got is None:
            raise KeyError(uid)
        return got


def apply(store: Store, table: str, t: curation.Transaction, audit: AuditStore, allowed: set[str] | None = None) -> str:
    """A transaction on a stored table: each edit is one version, so a fault keeps those before it; gives the status."""
    version = store.version(table)
    df = store.read(table)
    curation.apply(df, t, allowed=allowed, dry_run=True)
    audit.begin(t, version)
    done, error = 0, None
    for op in t.ops:
        try:
            store.rewrite(table, op.apply(store.read(table)), store.version(table))
        except (curation.PySparkException, ValueError, KeyError, TypeError) as e:
            error = f"{type(e).__name__}: {e}"[:2_000]
            break
        done += 1
    status = "applied" if done == len(t.ops) else "partial" if done else "failed"
    audit.finish(t, version, status, done, error)
    return status


def revert(store: Store, table: str, audit: AuditStore, uid: str) -> int:
    """The table as it was before a transaction, as a new version."""
    return store.restore(table, audit.version_before(uid))
