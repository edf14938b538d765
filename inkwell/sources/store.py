"""Tables of documents that can be rewritten: what belongs to a document is replaced or deleted in all tables at once.

Rows lie in buckets of their document, a folder for each bucket and version. A rewrite reads the buckets of its
documents only, writes them anew beside the old ones, and then commits a manifest that names the folders that count; the manifest is
one small file, renamed into place, so readers see the old version or the new one, and a rewrite that is killed leaves
the old. Each manifest has a number; a rewrite that finds its number taken has lost to another and raises Conflict.

The manifest has an entry for each bucket and table, whatever the number of documents."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another rewrite was committed first."""


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str
    buckets: int = 64
    key: str = "document_id"

    # Files, by Hadoop's own interface, so that any store that Spark writes to will do.
    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _manifests(self) -> list[int]:
        fs, at = self._fs(f"{self.root}/_manifests")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, number: int | None = None) -> dict:
        """number, and of each table its schema and the folder of each bucket that has rows; the last version, or an earlier one."""
        known = self._manifests()
        if not known and number is None:
            return {"number": 0, "tables": {}}
        fs, at = self._fs(f"{self.root}/_manifests/{(known[-1] if number is None else number):09d}.json")
        stream = fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, made: dict) -> None:
        name = f"{self.root}/_manifests/{made['number']:09d}.json"
        fs, there = self._fs(name)
        _, at = self._fs(f"{self.root}/_manifests/.{uuid.uuid4().hex}")
        out = fs.create(at, False)
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        if fs.exists(there) or not fs.rename(at, there):
            fs.delete(at, False)
            raise Conflict(f"version {made['number']} is there already")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _of(self, ids: DataFrame) -> list[int]:
        """The buckets of some documents: no more than there are."""
        return [r[0] for r in ids.select(self.bucket().alias("b")).distinct().collect()]

    def read(self, table: str, buckets: Sequence[int] | None = None, version: int | None = None) -> DataFrame:
        """A table, or some buckets of it; the last version, or an earlier one."""
        entry = self.manifest(version)["tables"].get(table)
        if entry is None:
            raise KeyError(table)
        schema = T.StructType.fromJson(entry["schema"])
        paths = [p for b, p in entry["buckets"].items() if buckets is None or int(b) in set(buckets)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def lookup(self, table: str, ids: DataFrame) -> DataFrame:
        """The rows of some documents (a table with the key); only files of their buckets are read."""
        named = ids.select(self.key).distinct()
        return self.read(table, self._of(named)).join(named, self.key, "left_semi")

    def replace(self, tables: dict[str, DataFrame], ids: DataFrame | None = None) -> int:
        """In all tables, what belongs to the documents of ids (else of the rows given) becomes the rows given. The number of the new version."""
        before = self.manifest()
        if ids is None:
            ids = None
            for rows in tables.values():
                own = rows.select(self.key)
                ids = own if ids is None else ids.unionByName(own)
        ids = ids.select(self.key).distinct()
        touched, version = self._of(ids), f"v{before['number'] + 1:09d}-{uuid.uuid4().hex[:8]}"
        made = {"number": before["number"] + 1, "tables": {k: dict(v, buckets=dict(v["buckets"])) for k, v in before["tables"].items()}}
        for table in sorted({*tables, *made["tables"]}):
            entry, new = made["tables"].get(table), tables.get(table)
            rows = new
            if entry is not None:
                kept = self.read(table, touched, before["number"]).join(ids, self.key, "left_anti")
                rows = kept if new is None else kept.unionByName(new)
            path = f"{self.root}/{table}/{version}"
            rows.withColumn("_bucket", self.bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(path)
            fs, at = self._fs(path)
            there = {int(s.getPath().getName().removeprefix("_bucket=")): str(s.getPath()) for s in fs.listStatus(at) if s.getPath().getName().startswith("_bucket=")}
            entry = entry or {"schema": json.loads(rows.schema.json()), "buckets": {}}
            entry["buckets"] = {b: p for b, p in entry["buckets"].items() if int(b) not in touched} | {str(b): p for b, p in there.items()}
            made["tables"][table] = entry
        self._commit(made)
        return made["number"]

    def delete(self, ids: DataFrame) -> int:
        """The documents leave every table."""
        return self.replace({}, ids)

    def vacuum(self, keep: int = 1) -> None:
        """Removes the folders that none of the last ``keep`` versions names, those of killed rewrites too. Not while one is under way."""
        known = self._manifests()
        used = {p.rpartition("/")[0].rpartition("/")[2] for n in known[-keep:] for t in self.manifest(n)["tables"].values() for p in t["buckets"].values()}
        for table in self.manifest()["tables"]:
            fs, at = self._fs(f"{self.root}/{table}")
            for s in fs.listStatus(at):
                if s.getPath().getName() not in used:
                    fs.delete(s.getPath(), True)
        for n in known[:-keep]:
            fs, at = self._fs(f"{self.root}/_manifests/{n:09d}.json")
            fs.delete(at, False)


def reprocess(store: Store, pages: DataFrame, config, at: str) -> int:
    """Documents (pages: document_id, page_number, raw_text) run through the pipeline again: their pages and chunks are replaced, and a job is added, in one version."""
    from ..operators import chunks

    clean = chunks.normalise_pages(pages)
    jobs = pages.select("document_id").distinct().select("document_id", F.lit("completed").alias("status"), F.to_timestamp(F.lit(at)).alias("created_at"))
    known = store.manifest()["tables"]
    earlier = store.lookup("jobs", jobs).unionByName(jobs) if "jobs" in known else jobs
    return store.replace({"pages": clean, "chunks": chunks.build_chunks(clean, config), "jobs": earlier}, jobs)
