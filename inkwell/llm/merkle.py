"""A Merkle manifest of a table, with a proof for each row.

A row's leaf is the digest of its columns. Within each group (source) leaves
ascend by id; every ``ARITY`` consecutive nodes become their parent until one is
left, the subroot; the subroots, ordered by group, likewise give the root.

Trees are built by events. A leaf is a partial parent that holds one child; in a
task partial parents of the same place are combined (children's digests by their
index), and once a parent holds as many as the size of its tree says it has, its
digest is known and it is itself an event for its own parent. So a task that has
a stretch of leaves gives whole subtrees and, at the stretch's ends, the frontier:
a few partial parents a level, with what they hold. Only these are exchanged, by
the ancestor ``STRIDE`` levels up, and combined again until no frontier is left.
A digest of a row is made where the row is read; texts are never exchanged.

Proofs follow the links back: each parent passes its children's digests, and what
it got from its own parent, down to its children, a join for each level.

Edge cases: null columns are part of the digest (``-``), null groups are a group
of their own and come first; null ids come first in theirs; rows that repeat an
id are ordered by their digest, and equal rows have equal leaves in any order; a
group of one row has its leaf as subroot; empty and very long texts are digested
whole; an empty table gives an empty result, and clashing columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved, small_side
from .sharding import numbered

ARITY, STRIDE = 16, 4
HEX = 64  # characters of a digest
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = -1  # the tree over the subroots
PARTIAL = "tree long, size long, level int, at long, mask long, held string"


def digest_of(values: list[Column]) -> Column:
    """Of the values in order: '-' if null, else bytes, ':' and value."""
    said = (F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (v.cast("string") for v in values))
    return F.sha2(F.concat(*said), 256)


def ordered(leaves: DataFrame) -> tuple[DataFrame, int]:
    """leaves (group, id, leaf, ...) with tree, the place of the group among all groups; size, the group's rows; and at, the row's place in the group. And the count of groups.

    One range exchange sorts the rows; what is added up is a row for each group and partition."""
    order = [F.asc_nulls_first(c) for c in ("group", "id", "leaf")]
    spot = saved(leaves.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("spot", F.monotonically_increasing_id()), "sorted")
    spot = spot.withColumn("part", F.shiftright("spot", 33))
    stretch = spot.groupBy("part", "group").agg(F.count("*").alias("n"), F.min("spot").alias("first"))
    before = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    stretch = saved(
        stretch.select("part", "group", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"), F.sum("n").over(Window.partitionBy("group")).alias("size")), "stretches"
    )
    groups, n = numbered(stretch.select("group", "size").distinct(), "group")
    groups = small_side(saved(groups.select(F.col("group").alias("g"), F.col("_row").alias("tree")), "groups"))
    stretch = stretch.join(groups, stretch["group"].eqNullSafe(groups["g"])).select(F.col("part").alias("p"), F.col("group").alias("g"), "first", "skip", "size", "tree")
    stretch = small_side(saved(stretch, "placed"))
    both = spot.join(stretch, (spot["part"] == stretch["p"]) & spot["group"].eqNullSafe(stretch["g"]))
    return both.withColumn("at", F.col("spot") - F.col("first") + F.col("skip")).drop("spot", "part", "p", "g", "first", "skip"), n


def width(size: int, level: int, arity: int) -> int:
    """Nodes of a level in a tree over so many leaves."""
    return -(-size // arity**level)


def parent(at: str, arity: int) -> Column:
    return F.expr(f"{at} DIV {arity}")


def combine(batches, arity: int):
    """Partial parents, combined. Rows with a digest are whole nodes; the others are the frontier that this task could not complete."""
    held: dict[tuple, dict[int, str]] = {}
    sizes: dict[int, int] = {}
    kind = pa.schema([("tree", pa.int64()), ("size", pa.int64()), ("level", pa.int32()), ("at", pa.int64()), ("mask", pa.int64()), ("held", pa.string()), ("digest", pa.string()), ("top", pa.bool_())])

    def rows(found):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*found, strict=True)) or [()] * len(kind), kind, strict=True)], schema=kind)

    for batch in batches:
        whole = []
        for tree, size, level, at, mask, said in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            slots = [s for s in range(arity) if mask >> s & 1]
            event = {s: said[k * HEX : (k + 1) * HEX] for k, s in enumerate(slots)}
            while event:
                got = held.setdefault((tree, level, at), {})
                got |= event
                if len(got) < min(arity, width(size, level - 1, arity) - arity * at):
                    sizes[tree] = size
                    break
                children = "".join(got[s] for s in range(len(got)))
                digest, top = hashlib.sha256(children.encode()).hexdigest(), width(size, level, arity) == 1
                whole.append((tree, size, level, at, (1 << len(got)) - 1, children, digest, top))
                del held[tree, level, at]
                event = {} if top else {at % arity: digest}
                level, at = level + 1, at // arity
        yield rows(whole)
    yield rows([(t, sizes[t], lv, at, sum(1 << s for s in got), "".join(got[s] for s in sorted(got)), None, False) for (t, lv, at), got in held.items()])


def build(leaves: DataFrame, arity: int = ARITY, stride: int = STRIDE) -> DataFrame:
    """The nodes above leaves (tree, size, at, digest) of trees with more than one: tree, level, at, held (their children's digests), digest and top."""

    def combined(df: DataFrame) -> DataFrame:
        made = df.select("tree", "size", "level", "at", "mask", "held").mapInArrow(lambda batches: combine(batches, arity), PARTIAL + ", digest string, top boolean")
        return saved(made, "nodes")

    single = F.expr(f"shiftleft(1L, CAST(at % {arity} AS INT))")
    events = leaves.filter("size > 1").select("tree", "size", F.lit(1).alias("level"), parent("at", arity).alias("up"), single.alias("mask"), F.col("digest").alias("held"))
    step = combined(events.withColumnRenamed("up", "at").sortWithinPartitions("tree", "at", "mask"))
    found = []
    while True:
        found.append(step.filter("digest IS NOT NULL").select("tree", "level", "at", "held", "digest", "top"))
        frontier = step.filter("digest IS NULL")
        if frontier.isEmpty():
            break
        # All that an ancestor needs from below meets in one task: what is left of arity ** stride leaves, at most.
        stage = F.expr(f"(level - 1) DIV {stride}")
        above = F.expr(f"at DIV CAST(pow({arity}, ((level - 1) DIV {stride} + 1) * {stride} - level) AS BIGINT)")
        step = combined(frontier.repartition("tree", stage, above))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def linked(nodes: DataFrame, tops: DataFrame, arity: int = ARITY) -> DataFrame:
    """tree, at, held, path and subroot of each node over leaves. tops: tree, subroot and path of each tree's top.

    A path is array<struct<held, slot>>, from the node up: the digests of the run a node stands in, and its place there."""
    highest = nodes.agg(F.max("level")).first()[0]
    if highest is None:
        return nodes.join(tops, "tree").select("tree", "at", "held", "path", "subroot")
    above = None
    for level in range(highest, 0, -1):
        own = nodes.filter(F.col("level") == level)
        here = own.filter("top").join(tops, "tree").select("tree", "at", "held", "path", "subroot")
        if above is not None:
            up = above.select("tree", F.col("at").alias("up"), F.col("held").alias("run"), F.col("path").alias("rest"), "subroot")
            below = own.filter("NOT top").withColumn("up", parent("at", arity)).join(up, ["tree", "up"])
            here = here.unionByName(below.select("tree", "at", "held", _path("run", F.col("at") % arity, "rest").alias("path"), "subroot"))
        above = here
    return above


def _path(run: str, slot: Column, rest: str) -> Column:
    return F.concat(F.array(F.struct(F.col(run).alias("held"), slot.cast("int").alias("slot"))), F.col(rest))


def proofs(docs: DataFrame, id: str = "doc_id", group: str = "source", columns=COLUMNS, also: dict[str, Column] | None = None, arity: int = ARITY) -> DataFrame:
    """id, leaf, subroot, root and path (see linked()) of each row of docs, and the columns of ``also``."""
    also = also or {}
    base = docs.select(docs[id].alias("id"), docs[group].alias("group"), digest_of([docs[c] for c in columns]).alias("leaf"), *(c.alias(f"also_{k}") for k, c in also.items()))
    rows, n = ordered(saved(base, "leaves"))
    rows = saved(rows.drop("group"), "placed_leaves")
    nodes = build(rows.select("tree", "size", "at", F.col("leaf").alias("digest")), arity)
    lone = rows.filter("size = 1").select("tree", F.col("leaf").alias("subroot"))
    subroots = saved(lone.unionByName(nodes.filter("top").select("tree", F.col("digest").alias("subroot"))), "subroots")
    upper = build(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(n).cast("long").alias("size"), F.col("tree").alias("at"), F.col("subroot").alias("digest")), arity)
    root = (upper.filter("top").select("digest") if n > 1 else subroots.select("subroot")).first()
    none = F.array().cast("array<struct<held:string,slot:int>>")
    if n > 1:
        start = docs.sparkSession.range(1).select(F.lit(TOP).cast("long").alias("tree"), F.lit(None).cast("string").alias("subroot"), none.alias("path"))
        over = linked(upper, start, arity).select(F.col("at").alias("up"), F.col("held").alias("run"), F.col("path").alias("rest"))
        at = subroots.withColumn("up", parent("tree", arity)).join(over, "up")
        tops = saved(at.select("tree", "subroot", _path("run", F.col("tree") % arity, "rest").alias("path")), "tops")
    else:
        tops = subroots.withColumn("path", none)
    alone = lone.drop("subroot").join(tops, "tree").select("tree", F.lit(0).cast("long").alias("at"), F.lit(None).cast("string").alias("held"), "path", "subroot")
    over = linked(nodes, tops, arity).unionByName(alone).withColumnsRenamed({"at": "up", "path": "rest"})
    path = F.when(F.col("held").isNull(), F.col("rest")).otherwise(_path("held", F.col("at") % arity, "rest"))
    both = rows.withColumn("up", parent("at", arity)).join(over, ["tree", "up"])
    return both.select("id", "leaf", "subroot", F.lit(root[0] if root else None).alias("root"), path.alias("path"), *(F.col(f"also_{k}").alias(k) for k in also))


def siblings(path: Column) -> Column:
    """The digests beside a leaf's way to the root, level by level."""
    cut = lambda p: F.concat(F.substr(p["held"], F.lit(1), p["slot"] * HEX), F.substr(p["held"], (p["slot"] + 1) * HEX + 1))
    return F.array_join(F.transform(path, cut), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of path."""

    def up(own: Column, p: Column) -> Column:
        return F.sha2(F.concat(F.substr(p["held"], F.lit(1), p["slot"] * HEX), own, F.substr(p["held"], (p["slot"] + 1) * HEX + 1)), 256)

    return F.aggregate(path, leaf, up)


def digests(docs: DataFrame) -> DataFrame:
    """Leaves, roots and proofs of docs, and the root recomputed for each row after every fifth row (by crc32 of its id) had its text's capitals lowered."""
    lowered = F.translate(docs["text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fifth = F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0, F.lit(False))
    found = proofs(docs, also={"shown": F.when(fifth, digest_of([lowered if c == "text" else docs[c] for c in COLUMNS]))})
    out = found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded(F.coalesce("shown", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
