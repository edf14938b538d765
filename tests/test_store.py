"""Rewrites and deletes of documents, killed rewrites, lookups that read their bucket only."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from inkwell.operators import chunks
from inkwell.sources.store import Conflict, Store, reprocess

IDS = "document_id string"


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"), buckets=8)
    rows = [(f"d{i}", f"text {i}") for i in range(40)]
    s.replace({"documents": spark.createDataFrame(rows, f"{IDS}, title string"), "chunks": spark.createDataFrame([(d, k, t) for d, t in rows for k in range(3)], f"{IDS}, chunk_index int, text string")})
    return s


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], IDS)


def test_delete_reaches_every_table(spark, store):
    assert (store.read("documents").count(), store.read("chunks").count()) == (40, 120)
    assert store.delete(ids(spark, "d3", "d4", "unknown")) == 2
    assert (store.read("documents").count(), store.read("chunks").count()) == (38, 114)
    assert store.read("chunks").filter("document_id in ('d3', 'd4')").count() == 0
    # The version before is still there.
    assert store.read("chunks", version=1).count() == 120
    store.vacuum()
    assert store.read("chunks").count() == 114 and store._manifests() == [2]


def test_replace_leaves_the_others(spark, store):
    store.replace({"chunks": spark.createDataFrame([("d5", 0, "new"), ("d99", 0, "first")], f"{IDS}, chunk_index int, text string")}, ids(spark, "d5", "d99"))
    got = {(r.document_id, r.chunk_index, r.text) for r in store.read("chunks").collect()}
    assert len(got) == 119 and {g for g in got if g[0] in ("d5", "d99")} == {("d5", 0, "new"), ("d99", 0, "first")}
    assert store.read("documents").filter("document_id = 'd5'").count() == 0  # a rewrite is of the whole document


def test_killed_rewrite_leaves_the_old_version(spark, store, monkeypatch):
    before = sorted(map(tuple, store.read("chunks").collect()))
    bad = F.when(F.col("chunk_index") == 1, F.raise_error(F.lit("killed"))).otherwise(F.col("text"))
    with pytest.raises(Exception, match="killed"):
        store.replace({"documents": spark.createDataFrame([("d1", "x")], f"{IDS}, title string"), "chunks": store.read("chunks").filter("document_id = 'd1'").withColumn("text", bad)})
    monkeypatch.setattr(Store, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        store.delete(ids(spark, "d1"))
    monkeypatch.undo()
    assert store.manifest()["number"] == 1 and sorted(map(tuple, store.read("chunks").collect())) == before
    store.vacuum()
    assert sorted(map(tuple, store.read("chunks").collect())) == before and store.delete(ids(spark, "d1")) == 2


def test_two_rewrites_do_not_both_count(spark, store):
    stale = store.manifest()
    store.delete(ids(spark, "d1"))
    with pytest.raises(Conflict):
        store._commit({**stale, "number": 2})
    assert store.read("documents").count() == 39


def test_lookup_reads_one_bucket(spark, store):
    found = store.lookup("chunks", ids(spark, "d7"))
    assert sorted((r.document_id, r.chunk_index) for r in found.collect()) == [("d7", k) for k in range(3)]
    files = found.inputFiles()
    bucket = ids(spark, "d7").select(store.bucket()).first()[0]
    assert files and all(f"_bucket={bucket}/" in f for f in files) and len(files) < len(store.read("chunks").inputFiles())
    assert store.lookup("chunks", ids(spark, "unknown")).count() == 0


def test_reprocess(spark, tmp_path):
    s, pages = Store(spark, str(tmp_path / "store"), 4), lambda t: spark.createDataFrame([("a", 1, t), ("b", 1, "Other\n\nOther body text.")], f"{IDS}, page_number int, raw_text string")
    reprocess(s, pages("Pump care\n\nPrime the pump."), chunks.Chunking(), "2024-01-01")
    reprocess(s, pages("Pump care\n\nPrime the pump twice.").filter("document_id = 'a'"), chunks.Chunking(), "2024-01-02")
    assert {r.document_id: r.text.split("\n\n")[-1] for r in s.read("chunks").collect()} == {"a": "Prime the pump twice.", "b": "Other body text."}
    assert sorted(r.document_id for r in s.read("jobs").collect()) == ["a", "a", "b"] and s.read("pages").count() == 2
