"""Tables as nodes of a dependency graph: inherited keys, computed only where missing.

A table is a folder of runs.  A run is written apart and renamed into place, whole, so that readers see all of it or nothing and
several sessions may add to one table.  Sessions that populate together claim buckets of keys; a key whose computation
fails can be set apart; and rows are deleted together with all that was computed from them.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochal.operators.algebra import natural_join


#: Rows that a parent without shared key columns may have.
PARAMETERS = 10_000


@dataclass
class Node:
    """name; key columns; parents by name; compute(todo keys, parents' tables) -> rows."""

    name: str
    key: list[str]
    parents: list[str] = field(default_factory=list)
    compute: Callable[[DataFrame, dict[str, DataFrame]], DataFrame] | None = None
    keep: str | None = None  # restriction of the keys to compute
    only: dict[str, str] = field(default_factory=dict)  # restrictions of parents' rows, by parent
    also: list[str] = field(default_factory=list)  # tables that compute reads where they are there; no part of the keys


class Schema:
    """A registry of nodes whose tables are folders below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.nodes = spark, root.rstrip("/"), {}

    def add(self, node: Node) -> Node:
        for p in node.parents:
            if p not in self.nodes:
                raise KeyError(f"{node.name}: unknown parent {p}")
        self.nodes[node.name] = node
        return node

    def order(self) -> list[str]:
        """Parents first; insertion already guarantees it."""
        return list(self.nodes)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))

    def _listed(self, name: str) -> list:
        fs, p = self._fs(), self._at(name)
        return [f for f in fs.listStatus(p)] if fs.exists(p) else []

    def has(self, name: str) -> bool:
        return any(f.getPath().getName()[0] not in "_." for f in self._listed(name))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", "true").parquet(self.path(name))

    def publish(self, name: str, rows: DataFrame) -> None:
        """Add rows as a run of their own: written beside the table, then renamed into it."""
        run = uuid.uuid4().hex
        rows.write.parquet(self.path(f"_staging/{run}"))
        self._fs().mkdirs(self._at(name))
        if not self._fs().rename(self._at(f"_staging/{run}"), self._at(f"{name}/run-{run}")):
            raise OSError(f"{name}: the run could not be moved into place")

    def insert(self, name: str, rows: DataFrame) -> None:
        """Append rows whose key is not there yet."""
        node = self.nodes[name]
        if self.has(name):
            rows = rows.join(self.table(name).select(*node.key), node.key, "left_anti")
        self.publish(name, rows)

    def key_source(self, name: str) -> DataFrame:
        """Keys of all parents joined on what they share; payload is never read for this."""
        out = None
        for p in self.nodes[name].parents:
            keys = self.table(p).where(self.nodes[name].only.get(p, "true")).select(*self.nodes[p].key).distinct()
            out = keys if out is None else natural_join(out, keys, PARAMETERS)
        return out.where(self.nodes[name].keep) if self.nodes[name].keep else out

    def tried(self, name: str) -> str:
        """Where the keys stand that were computed, whether they gave rows or not."""
        return f"_tried/{name}"

    def errors(self, name: str) -> str:
        """Where the keys stand whose computation failed, with the message."""
        return f"_errors/{name}"

    def missing(self, name: str, where=None) -> DataFrame:
        """Keys of the source that were not computed yet, have no rows and did not fail; ``where`` (a predicate, or a frame of keys) restricts them."""
        out = self.key_source(name)
        if isinstance(where, str):
            out = out.where(where)
        elif where is not None:
            out = out.join(where, [c for c in where.columns if c in out.columns], "left_semi")
        on = [k for k in self.nodes[name].key if k in out.columns]
        for table in (name, self.tried(name), self.errors(name)):
            if self.has(table):
                out = out.join(self.table(table).select(*on).distinct(), on, "left_anti")
        return out

    def populate(self, name: str, limit: int | None = None, where=None, reserve: bool = False, suppress_errors: bool = False, buckets: int = 64, expires: float = 3600.0, most_errors: int = 100) -> int:
        """Compute the missing keys (``limit`` of them, if given; restricted by ``where``) and append; returns their number.  Keys that give no
        rows are not computed again until :meth:`forget`.

        ``reserve``: keys fall in ``buckets`` by hash, and only those are computed whose buckets this session can claim; a claim holds for
        ``expires`` seconds, which the computation must not exceed.  ``suppress_errors``: where a computation fails, its keys are
        halved until the failing ones stand alone; these go to the table :meth:`errors` and are left out
        until :meth:`retry`, the others are computed.  Over ``most_errors`` failing keys are an error after all."""
        held = []
        try:
            todo = self.missing(name, where)
            if reserve:
                bucket = F.pmod(F.xxhash64(*todo.columns), F.lit(buckets))
                wanted = sorted(r[0] for r in todo.select(bucket.alias("b")).distinct().collect())  # at most ``buckets`` rows
                held = [b for b in wanted if self._claim(f"_claims/{name}/{b}", expires)]
                if not held:
                    return 0
                # Asked again: what another session finished meanwhile is there now.
                self.spark.catalog.refreshByPath(self.root)
                todo = self.missing(name, where).where(bucket.isin(held))
            if limit is not None:
                todo = todo.orderBy(*todo.columns).limit(limit)
            pending = f"_pending/{name}-{uuid.uuid4().hex}"
            todo.write.parquet(self.path(pending))
            todo = self.table(pending)
            n = todo.count()
            if n:
                n -= self._compute(name, todo, most_errors if suppress_errors else 0)
            self._delete(pending)
            return n
        finally:
            for b in held:
                self._delete(f"_claims/{name}/{b}")

    def _compute(self, name: str, todo: DataFrame, errors: int, turn: int = 0) -> int:
        """Compute and append; with ``errors`` allowed, set failing keys apart.  Returns how many failed."""
        node = self.nodes[name]
        try:
            self.publish(name, node.compute(todo, {p: self.table(p) for p in [*node.parents, *(a for a in node.also if self.has(a))]}))
            self.publish(self.tried(name), todo)
            return 0
        except Exception as e:
            if not errors:
                raise
            if todo.count() == 1:
                told = f"{type(e).__name__}: {e}"[:2000]
                self.publish(self.errors(name), todo.withColumns({"error": F.lit(told), "at": F.current_timestamp()}))
                return 1
        failed = 0
        for half in (0, 1):
            part = todo.where(F.pmod(F.xxhash64(*todo.columns, F.lit(turn)), F.lit(2)) == half)
            if not part.isEmpty():
                failed += self._compute(name, part, errors, turn + 1)
                if failed > errors:
                    raise RuntimeError(f"{name}: over {errors} keys fail")
        return failed

    def retry(self, name: str) -> None:
        """Let failed keys be computed again."""
        self._delete(self.errors(name))

    def _claim(self, name: str, expires: float) -> bool:
        """Take a claim if nobody holds it, or its holder let it expire.  A folder of our own is renamed to the claim's name: whose
        folder stands there first holds it, as its content tells."""
        fs, mine = self._fs(), uuid.uuid4().hex
        own = f"_claims/_{mine}"
        for _ in range(2):
            fs.mkdirs(self._at(f"{own}/{mine}"))
            fs.mkdirs(self._at(name).getParent())
            if not fs.exists(self._at(name)):
                try:
                    fs.rename(self._at(own), self._at(name))
                except Exception:  # noqa: BLE001, S110  (some file systems raise where others return false)
                    pass
            if fs.exists(self._at(f"{name}/{mine}")):
                return True
            # Where it stood already, some file systems move ours inside.
            fs.delete(self._at(f"{name}/_{mine}"), True)
            fs.delete(self._at(own), True)
            if not fs.exists(self._at(name)) or time.time() - fs.getFileStatus(self._at(name)).getModificationTime() / 1000 < expires:
                return False
            if not fs.rename(self._at(name), self._at(f"_claims/_old-{mine}")):
                return False
            self._delete(f"_claims/_old-{mine}")
        return False

    def populate_all(self, names: list[str] | None = None) -> dict[str, int]:
        """All computed tables whose parents are there, parents first."""
        made = {}
        for name in names or self.order():
            node = self.nodes[name]
            if node.compute and all(self.has(p) for p in node.parents):
                made[name] = self.populate(name)
        return made

    def forget(self, name: str) -> None:
        """Let keys without rows be tried again."""
        self._delete(self.tried(name))

    def reflect(self) -> dict[str, list[str]]:
        """Tables that stand below the root, declared or not, with their columns."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return {n: self.table(n).columns for n in sorted(names) if not n.startswith("_")}

    def inputs(self, name: str) -> list[str]:
        """All tables that a node rests on, parents first."""
        out: list[str] = []
        for p in self.nodes[name].parents:
            out += [q for q in [*self.inputs(p), p] if q not in out]
        return out

    def children(self, name: str) -> list[str]:
        return [n for n in self.nodes if name in self.nodes[n].parents]

    def doomed(self, name: str, where) -> dict[str, DataFrame]:
        """Keys that go when the rows of ``name`` that match ``where`` (a predicate, or a frame of keys) go: of the node itself, and of every
        table below it those that share the gone keys' columns (all keys of a child that shares none: it rests on the whole table)."""
        self.recover()
        out: dict[str, DataFrame] = {}
        for n in self.order():
            if not (self.has(n) or self.has(self.tried(n)) or self.has(self.errors(n))):
                continue
            node, gone = self.nodes[n], None
            if n == name:
                rows = self.table(n) if self.has(n) else None
                if rows is not None:
                    gone = rows.where(where) if isinstance(where, str) else rows.join(where, [c for c in where.columns if c in rows.columns], "left_semi")
                    gone = gone.select(*node.key).distinct()
            else:
                for p in (p for p in node.parents if p in out):
                    keys, on = self._keys(n), [k for k in out[p].columns if k in node.key]
                    hit = keys.join(out[p].select(*on).distinct(), on, "left_semi") if on else keys.join(out[p].limit(1).select(F.lit(1).alias("_")), how="left_semi")
                    gone = hit if gone is None else gone.unionByName(hit).distinct()
            if gone is not None:
                at = f"_pending/gone-{n}-{uuid.uuid4().hex}"
                gone.write.parquet(self.path(at))
                out[n] = self.table(at)
                out[n]._pending = at
        return out

    def _keys(self, name: str) -> DataFrame:
        """All keys a node has, tried or failed."""
        out, key = None, self.nodes[name].key
        for t in (name, self.tried(name), self.errors(name)):
            if self.has(t):
                rows = self.table(t)
                if set(key) <= set(rows.columns):
                    rows = rows.select(*key).distinct()
                    out = rows if out is None else out.unionByName(rows)
        return out.distinct()

    def delete(self, name: str, where="true", dry: bool = False) -> dict[str, int]:
        """Delete the rows of ``name`` that match ``where``, and, table by table, all that was computed from them; returns the numbers of keys.
        With ``dry`` nothing is deleted.

        Only runs that hold a deleted row are written anew, and each is exchanged by renaming; tables farthest below go first, so that
        what is left after a failure is complete and the call can be repeated."""
        gone = self.doomed(name, where)
        counts = {n: keys.count() for n, keys in gone.items()}
        for n in reversed(list(gone)):
            if counts[n] and not dry:
                for t in (n, self.tried(n), self.errors(n)):
                    self._without(t, gone[n])
            self._delete(gone[n]._pending)
        return counts

    def _without(self, name: str, keys: DataFrame) -> None:
        if not self.has(name):
            return
        on = [c for c in keys.columns if c in self.table(name).columns]
        rows = self.table(name).withColumn("_file", F.input_file_name())
        touched = [r[0] for r in rows.join(keys, on, "left_semi").select(F.regexp_extract("_file", r"/run-([0-9a-f]{32})/", 1).alias("r")).distinct().collect()]  # one row a run
        for run in filter(None, touched):
            old = self.spark.read.parquet(self.path(f"{name}/run-{run}"))
            old.join(keys, on, "left_anti").write.parquet(self.path(f"_staging/{run}"))
            self._fs().rename(self._at(f"{name}/run-{run}"), self._at(f"{name}/_gone-{run}"))
            self._exchange(name, run)
        self.spark.catalog.refreshByPath(self.path(name))

    def _exchange(self, name: str, run: str) -> None:
        """Second half of an exchange: the new run comes in and the old one goes; if the new one is not whole, the old one comes back."""
        fs = self._fs()
        if not fs.exists(self._at(f"{name}/run-{run}")):
            new = f"_staging/{run}" if fs.exists(self._at(f"_staging/{run}/_SUCCESS")) else f"{name}/_gone-{run}"
            fs.rename(self._at(new), self._at(f"{name}/run-{run}"))
        self._delete(f"{name}/_gone-{run}")

    def recover(self) -> None:
        """Finish exchanges that a lost session left half done."""
        for n in self.nodes:
            for t in (n, self.tried(n), self.errors(n)):
                for f in self._listed(t):
                    if (x := f.getPath().getName()).startswith("_gone-"):
                        self._exchange(t, x.removeprefix("_gone-"))

    def drop(self, name: str) -> None:
        """The whole table, and its marks; what was computed from it stays (:meth:`delete` takes that along)."""
        for t in (name, self.tried(name), self.errors(name)):
            self._delete(t)

    def drop_all(self) -> None:
        for name in self.reflect():
            self.drop(name)

    def _delete(self, name: str) -> None:
        self._fs().delete(self._at(name), True)


def guarded(kernel, key: str, columns: str):
    """A grouped map that returns an ``error`` text for a failing key and goes on with the others."""
    import pandas as pd

    names = [c.split()[0] for c in columns.split(", ")]

    def run(k, pdf):
        try:
            return kernel(pdf).assign(error=None)
        except Exception as e:  # noqa: BLE001  (per-key isolation is the feature)
            return pd.DataFrame([{**dict.fromkeys(names), key: k[0], "error": f"{type(e).__name__}: {e}"}])[[*names, "error"]]

    return run, columns + ", error string"
