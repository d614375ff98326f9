"""Tables that change together: versions with delta folders, removals read as a merge, and one commit for all.

A store is a folder.  Each table has folders of rows and folders of removed keys, each written once
and never changed.  A version is a manifest that lists the folders which count; it comes into being by one
rename, so readers see a change of many tables as a whole or not at all.  The rename must be atomic
and must not replace a file (HDFS and local file systems; not plain object stores).
"""

import json
import math
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from snipquarry.plans.scratch import ONCE

VERSION = "_version"
# Folders of about one size that are merged into one, and how much larger the next size is.
FANOUT = 8
# Most values that a file's Bloom filter is made for; a row group seldom has more rows.
FILTER_VALUES = 1_000_000


class Conflict(RuntimeError):
    """Another change was committed first; this one has to be made again from what is there now."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._java = jvm.org.apache.hadoop.fs
        self._fs = self._java.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._text = lambda stream: jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")

    # --- versions

    def _file(self, name: str):
        return self._java.Path(f"{self.path}/{name}")

    def _manifest_file(self, version: int):
        return self._file(f"_manifests/{version:012d}.json")

    def versions(self) -> list[int]:
        folder = self._file("_manifests")
        if not self._fs.exists(folder):
            return []
        names = [status.getPath().getName() for status in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, or of the latest; that of an empty store has version 0."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "tables": {}, "done": {}}
        stream = self._fs.open(self._manifest_file(version))
        try:
            return json.loads(self._text(stream))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        target, waiting = self._manifest_file(manifest["version"]), self._file(f"_manifests/{uuid.uuid4().hex}.new")
        stream = self._fs.create(waiting)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        context = self._java.FileContext.getFileContext(target.toUri(), self._fs.getConf())
        try:
            # Without the option to overwrite, this fails where the version is there already.
            context.rename(waiting, target, self.spark.sparkContext._gateway.new_array(getattr(self._java, "Options$Rename"), 0))
        except Exception as problem:
            self._fs.delete(waiting, False)
            if "AlreadyExists" in str(problem):
                raise Conflict(f"version {manifest['version']} of {self.path} was committed by another run") from problem
            raise

    # --- reading

    def tables(self, version: int | None = None) -> list[str]:
        return sorted(self.manifest(version)["tables"])

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The rows of a table: those that no later change has removed."""
        manifest = self.manifest(version)
        if table not in manifest["tables"]:
            raise KeyError(f"no table {table} in {self.path}")
        return self._rows(table, manifest["tables"][table])

    def _folders(self, table: str, entries: list[dict], schema: T.StructType) -> DataFrame:
        schema = T.StructType([*schema.fields, T.StructField(VERSION, T.LongType())])
        if not entries:
            return self.spark.createDataFrame([], schema)
        base = f"{self.path}/{table}"
        paths = [f"{base}/{e['folder']}" for e in entries]
        return self.spark.read.option("basePath", base).schema(schema).parquet(*paths)

    def _rows(self, table: str, state: dict, only: list[dict] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(state["schema"])
        data = state["data"] if only is None else only
        last = max((e["version"] for e in state["removed"]), default=0)
        # Rows at least as new as the last removal need no look at the removed keys.
        older = [e for e in data if e["version"] < last]
        rows = self._folders(table, [e for e in data if e["version"] >= last], schema).drop(VERSION)
        if not older:
            return rows
        found, first = self._folders(table, older, schema), min(e["version"] for e in older)
        for by in sorted({tuple(e["by"]) for e in state["removed"]}):
            entries = [e for e in state["removed"] if tuple(e["by"]) == by and e["version"] > first]
            if entries:
                keys = T.StructType([f for f in schema if f.name in by])
                removed = self._folders(table, entries, keys).groupBy(*by).agg(F.max(VERSION).alias("_removed"))
                found = found.join(removed, list(by), "left").filter(F.coalesce(F.col("_removed") <= F.col(VERSION), F.lit(True))).drop("_removed")
        found = found.select(*schema.names)
        return found if len(older) == len(data) else found.unionByName(rows)

    # --- changing

    def change(self, by: str | None = None, step: int | None = None) -> "Change":
        """A change of any of the tables, as a context: it is committed at its end, unless that raises.

        `by` and `step` name who writes and its how-manieth time it is (a stream and its batch), so that a
        repeated step can be seen by `Change.repeated`.
        """
        return Change(self, by, step)

    def compact(self, table: str, fanout=FANOUT, whole=False) -> int:
        """Merge folders of about one size where there are `fanout` of them, and forget removals that
        hide nothing any more; with `whole`, everything.  Returns how many folders were merged.

        A row is rewritten about once for each time that the table grows by `fanout`.
        """
        manifest = self.manifest()
        state = manifest["tables"][table]
        tiers = {}
        for e in state["data"]:
            tiers.setdefault(int(math.log(max(e["bytes"], 1), fanout)), []).append(e)
        merged = state["data"] if whole else [e for tier in tiers.values() if len(tier) >= fanout for e in tier]
        if not merged or whole and len(merged) == 1 and not state["removed"]:
            return 0
        with Change(self, None, None, manifest) as change:
            rest = [e for e in state["data"] if e not in merged]
            rows = self._rows(table, state, merged)
            change.state(table, rows.schema)["data"] = rest
            change.append(table, rows.coalesce(max(1, sum(e["bytes"] for e in merged) >> 27)))
        return len(merged)

    def vacuum(self, keep=1) -> int:
        """Delete all but the last `keep` manifests, and the folders that none of these lists; no change may be running."""
        versions = self.versions()
        kept = [self.manifest(v) for v in versions[-keep:]] if keep else []
        for version in versions[:len(versions) - len(kept)]:
            self._fs.delete(self._manifest_file(version), False)
        wanted = {f"{t}/{e['folder']}" for m in kept for t, s in m["tables"].items() for e in s["data"] + s["removed"]}
        gone = 0
        for table in self._fs.listStatus(self._file("")):
            name = table.getPath().getName()
            if name == "_manifests":
                continue
            for version in self._fs.listStatus(table.getPath()):
                for folder in self._fs.listStatus(version.getPath()):
                    if f"{name}/{version.getPath().getName()}/{folder.getPath().getName()}" not in wanted:
                        gone += self._fs.delete(folder.getPath(), True)
        return gone


class Change:
    """Writes to tables of a store that become visible together."""

    def __init__(self, store: Store, by: str | None, step: int | None, base: dict | None = None):
        self.store, self.by, self.step = store, by, step
        base = json.loads(json.dumps(base or store.manifest()))
        self.version = base["version"] + 1
        self.tables, self.done = base["tables"], base["done"]
        self.repeated = by is not None and self.done.get(by, -1) >= step
        self.bytes = 0

    def state(self, table: str, schema: T.StructType) -> dict:
        return self.tables.setdefault(table, {"schema": json.loads(schema.json()), "data": [], "removed": []})

    def _write(self, table: str, rows: DataFrame, order, find_by, once=False) -> dict:
        folder = f"{VERSION}={self.version}/{uuid.uuid4().hex}"
        seen = Observation()
        counted = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
        writer = (counted.sortWithinPartitions(*order) if order else counted).write.options(**(ONCE if once else {}))
        if find_by and once:
            # Rows with long values are not counted first: of filters from 2 KB to 1 MB a file keeps the least that holds its values.
            writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
            for column in find_by:
                writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.candidates.number#{column}", "10")
        elif find_by:
            # Filters of a size that their values ask for; by itself each would take a megabyte.
            values = min(max(rows.count(), 1), FILTER_VALUES)
            for column in find_by:
                writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
                writer = writer.option(f"parquet.bloom.filter.expected.ndv#{column}", str(values))
        writer.parquet(f"{self.store.path}/{table}/{folder}")
        size = self.store._fs.getContentSummary(self.store._file(f"{table}/{folder}")).getLength()
        self.bytes += size
        return {"folder": folder, "version": self.version, "rows": seen.get["rows"], "bytes": size}

    def append(self, table: str, rows: DataFrame, order=(), find_by=(), once=False) -> int:
        """Add rows and return how many.

        With `order`, files are sorted by these columns; with `find_by`, they carry Bloom filters of
        them, so that a lookup of few values reads few pages (the rows are counted first: give stored ones).
        With `once`, a file holds a long value that many of its rows have only once.
        """
        state = self.state(table, rows.schema)
        names = T.StructType.fromJson(state["schema"]).names
        entry = self._write(table, rows.select(*names), order, find_by, once)
        if entry["rows"]:
            state["data"].append(entry)
        return entry["rows"]

    def remove(self, table: str, keys: DataFrame) -> None:
        """Remove what the table had before this change with any of `keys`, compared by all columns of that.

        Only the keys are written.  Rows that this change itself appends stay; NULL is no key.
        """
        if table not in self.tables or not self.tables[table]["data"]:
            return
        entry = self._write(table, keys.distinct(), (), ())
        if entry["rows"]:
            self.tables[table]["removed"].append(entry | {"by": keys.columns})

    def replace(self, table: str, rows: DataFrame, keys: DataFrame, order=(), find_by=(), once=False) -> int:
        """Remove what the table has of the keys and add the rows."""
        self.remove(table, keys)
        return self.append(table, rows, order, find_by, once)

    def commit(self) -> None:
        for state in self.tables.values():
            oldest = min((e["version"] for e in state["data"]), default=self.version)
            state["removed"] = [e for e in state["removed"] if e["version"] > oldest]
        if self.by is not None:
            self.done[self.by] = self.step
        self.store._publish({"version": self.version, "tables": self.tables, "done": self.done})

    def __enter__(self) -> "Change":
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None and not self.repeated:
            self.commit()
