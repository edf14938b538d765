"""Repeated byte strings: maximal repeats from common-prefix interval trees.

A byte goes if a string of LENGTH (``BYTES.length``) bytes that covers it also starts anywhere
else in the corpus. All texts can't stand in one suffix array, so suffixes are
first dealt out by content. Of every window of LENGTH bytes the least hashed
K-gram (K: ``BYTES.gram``; leftmost of equals) is its anchor; equal windows have equal anchors at
the same place, so a repeat of LENGTH bytes or more shows as two anchors of
equal K-grams. An anchor owns the windows that it is the anchor of, one run of
starts; its context is the text that these cover. Each window is owned once.

1. Each text gives the K-gram hash and the context (a hash of 128 bits) of its
   anchors, about 2 in LENGTH - K bytes. Equal contexts are equal suffixes, so
   they are one leaf with a count from here on: a leaf of two places or more is
   a repeat as a whole, and an exact copy costs no more than a count.
2. The different contexts of one K-gram go to one task, which sorts their
   suffixes from the anchor (an enhanced suffix array: order and lengths of
   common prefixes) and finds the tree of common-prefix intervals with a stack
   scan. In an interval of prefix length r, contexts whose texts before the
   anchor agree in l bytes, l + r >= LENGTH, and don't all come from one child
   of the interval are a maximal repeat; where they stop to agree (the left
   extensions differ), the group ends. All members of all such groups count.
3. A K-gram with more than ``BUCKET`` different contexts (a phrase that a large
   share of the corpus uses in different surroundings) is split before: the
   places where windows may start, relative to the anchor, are cut into cells,
   and each context goes, cut to the cell, with those that agree in all bytes
   that the cell's windows share: a longer key, so fewer members, and contexts
   that only differ elsewhere become one leaf. Cells shrink to one window, whose
   contexts are all alike; so no group of over BUCKET contexts is ever built.
4. The spans go back to all occurrences, and each text is cut.

The same over words in place of bytes (a word is a symbol of 8 bytes, its hash)
finds passages of ``WORDS.length`` words that another document has too, which
may be shorter than LENGTH bytes: they are reported, not removed.

Edge cases: null and empty texts, and texts under LENGTH bytes, keep all; a text
can repeat within itself, overlapping too; rows that repeat an id and text are
copies of each other; very long texts are read in blocks; columns besides
doc_id and text are not looked at, so their names can't clash; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fits, kept_after, saved, small_side


@dataclass(frozen=True)
class Law:
    """What counts as a repeat: length symbols of unit bytes each, found by grams of so many symbols; across: only if another row has it."""

    length: int
    gram: int
    unit: int = 1
    across: bool = False

    def symbols(self, text: bytes) -> bytes:
        return text if self.unit == 1 else b"".join(map(xxhash.xxh3_64_digest, text.split()))

    def array(self, symbols: bytes) -> np.ndarray:
        return np.frombuffer(symbols, dtype=np.uint8 if self.unit == 1 else "<u8")


BYTES, WORDS = Law(400, 128), Law(50, 10, 8, across=True)
#: Most different contexts that are put into one tree: 512 have 0.3 MB at most.
BUCKET = 512
#: Cells are this many times smaller with each split.
SPLIT = 4
#: Window starts that are looked at together, which bounds the memory for a long text.
BLOCK = 1 << 19
_BASE = 0x9E3779B97F4A7C15
#: Of the K-gram, and of the context, which has the K-gram in it.
CONTEXT = ["gram", "c1", "c2"]
ROW = ["_row", "_crc"]
SPANS = "array<struct<a:bigint,b:bigint>>"


def gram_hashes(b: np.ndarray, size: int) -> np.ndarray:
    """A polynomial hash of each gram of so many symbols. Its high bits are the good ones."""
    n = len(b) - size + 1
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(b), _BASE, dtype=np.uint64))
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power)])
        return (total[size:] - total[:n]) * np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64))


def anchors(b: np.ndarray, length: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place and hash of each anchor of a text, and the first and last start of the windows it owns."""
    if len(b) < length:
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=np.int64),) * 2
    parts = []
    for at in range(0, len(b) - length + 1, BLOCK):
        piece = b[at : at + BLOCK + length - 1]
        h = gram_hashes(piece, size)
        width = length - size + 1
        # Of equal high halves the leftmost, in any text alike.
        ranked = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
        # Least of each run of `width`: running minima within groups of so many, from both ends.
        pad = -len(ranked) % width
        groups = np.concatenate([ranked, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, width)
        ahead = np.minimum.accumulate(groups[:, ::-1], axis=1)[:, ::-1].ravel()
        behind = np.minimum.accumulate(groups, axis=1).ravel()
        count = len(ranked) - width + 1
        least = np.minimum(ahead[:count], behind[width - 1 : width - 1 + count]) & np.uint64(0xFFFFFFFF)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        places = least[first].astype(np.int64)
        last = np.concatenate([first[1:], [count]]) - 1
        parts.append((places + at, h[places].view(np.int64), first + at, last + at))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def ordered(texts: list[bytes], unit: int) -> tuple[list[int], list[int]]:
    """The order of the texts, and how many symbols each shares with the one before it there."""
    order = sorted(range(len(texts)), key=texts.__getitem__)
    return order, [0, *(common_prefix(texts[i], texts[j]) // unit for i, j in zip(order, order[1:], strict=False))]


def intervals(lcp: list[int], n: int):
    """(prefix length, first, last) of each node of the tree over n sorted
    suffixes, lcp[i] being what suffixes i - 1 and i share. Children come first."""
    stack = [(0, 0)]
    for i in range(1, n + 1):
        now, first = (lcp[i] if i < n else -1), i - 1
        while stack and stack[-1][0] > now:
            length, first = stack.pop()
            yield length, first, i - 1
        if i < n and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def maximal_repeats(contexts: list[tuple[int, bytes]], law: Law = BYTES):
    """(symbols from the anchor, members, what each member shares before the anchor with the one before it in the list)
    of each group of different contexts (symbols before the anchor, all) that share law.length symbols or more."""
    order, lcp = ordered([t[a * law.unit :] for a, t in contexts], law.unit)
    left, between = ordered([t[: a * law.unit][::-1] for a, t in contexts], law.unit)
    place, rank = {k: i for i, k in enumerate(order)}, [0] * len(order)
    for r, k in enumerate(left):
        rank[place[k]] = r
    for right, first, last in intervals(lcp, len(order)):
        inner = sorted(rank[first : last + 1])
        shared = [0, *(min(between[a + 1 : b + 1]) for a, b in zip(inner, inner[1:], strict=False))]
        start = 0
        for i in range(1, len(inner) + 1):
            if i < len(inner) and shared[i] + right >= law.length:
                continue
            if i - start > 1:
                group = [left[r] for r in inner[start:i]]
                at = [place[k] for k in group]
                # Right-maximal only if the group isn't all within one child of the interval.
                if min(lcp[min(at) + 1 : max(at) + 1]) == right:
                    yield right, group, [0, *shared[start + 1 : i]]
            start = i


def covered(contexts: list[tuple[int, bytes]], rows: list[tuple[int, int]], law: Law = BYTES) -> list[list[tuple[int, int]]]:
    """Spans (start, end), relative to the anchor, of each context. rows: the least and greatest row that has it."""
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    for right, group, shared in maximal_repeats(contexts, law):
        if law.across and len({r for k in group for r in rows[k]}) == 1:
            continue
        for k, here, after in zip(group, shared, [*shared[1:], 0], strict=True):
            out[k].append((-max(here, after), right))
    return [joined(s) for s in out]


def joined(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _row(df: DataFrame) -> DataFrame:
    """_row, _crc: hashes of id and text that tell rows apart; equal rows share them."""
    text = F.coalesce("text", F.lit(""))
    return df.select("doc_id", "text", F.xxhash64("doc_id", text).alias("_row"), F.crc32(F.encode(text, "UTF-8")).alias("_crc"))


def _halves(digests: list[bytes]) -> list[np.ndarray]:
    return list(np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2).T)


def _spans_array(spans: list[list[tuple[int, int]]]) -> pa.Array:
    flat = np.array([x for s in spans for x in s], dtype=np.int64).reshape(-1, 2)
    each = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["a", "b"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, spans)]), pa.int32()), each)


def _occurrences(base: DataFrame, law: Law) -> DataFrame:
    """_row, _crc, gram, c1, c2, at, before, after of each anchor of each row, in symbols."""
    names, small, u = [*ROW, *CONTEXT, "at", "before", "after"], {"at", "before", "after"}, law.unit

    def run(batches):
        for batch in batches:
            rows, places, contexts = [], [], []
            for row, crc, text in zip(*(c.to_pylist() for c in (batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()))), strict=True):
                symbols = law.symbols(text)
                at, gram, first, last = anchors(law.array(symbols), law.length, law.gram)
                contexts += [xxhash.xxh3_128_digest(symbols[i * u : (j + law.length) * u], seed=p - i) for p, i, j in zip(at.tolist(), first.tolist(), last.tolist(), strict=True)]
                places.append(np.stack([gram, at, at - first, last + law.length - at]))
                rows.append(np.repeat(np.array([[row], [crc]]), len(at), axis=1))
            r, p = np.concatenate(rows, axis=1), np.concatenate(places, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if n in small else pa.int64()) for n, x in zip(names, (*r, p[0], *_halves(contexts), *p[1:]), strict=True)], names=names)

    # Words have a byte and a blank at least.
    long = base.filter(F.octet_length("text") >= (law.length if u == 1 else 2 * law.length - 1)).select(*ROW, "text")
    return long.mapInArrow(run, ", ".join(f"{n} {'int' if n in small else 'long'}" for n in names))


PIECE = [*CONTEXT, "before", "lo", "hi", "piece"]
PIECES = ", ".join(f"{c} long" for c in PIECE[:-1]) + ", piece binary"


def _pieces(holders: DataFrame, law: Law) -> DataFrame:
    """PIECE of each listed place of a text."""
    kinds, u = (pa.int64(),) * 6 + (pa.binary(),), law.unit

    def cut(batches):
        for batch in batches:
            for text, places in zip(batch.column(0).cast(pa.binary()), batch.column(1), strict=True):
                text, places = law.symbols(text.as_py()), places.as_py()
                out = [(p["gram"], p["c1"], p["c2"], p["before"], p["lo"], p["hi"], text[(p["at"] - p["before"]) * u : (p["at"] + p["after"]) * u]) for p in places]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=PIECE)

    return holders.mapInArrow(cut, PIECES)


def _trees(pieces: DataFrame, law: Law) -> DataFrame:
    """gram, c1, c2, spans of pieces, by K-gram; a K-gram has few enough of them for one task."""

    def run(batches):
        def done(members):
            spans = covered([(a, t) for _, _, _, a, _, _, t in members], [(x, y) for *_, x, y, _ in members], law)
            return [(*m[:3], s) for m, s in zip(members, spans, strict=True) if s]

        def told(rows):
            *keys, spans = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([*(pa.array(k, pa.int64()) for k in keys), _spans_array(spans)], names=[*CONTEXT, "spans"])

        members: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if members and row[0] != members[0][0]:
                    out += done(members)
                    members = []
                if not members or row[:3] != members[-1][:3]:
                    members.append(row)
            if out:
                yield told(out)
        if members and (out := done(members)):
            yield told(out)

    dealt = pieces.select(*PIECE).repartition("gram").sortWithinPartitions(*CONTEXT)
    return dealt.mapInArrow(run, f"gram long, c1 long, c2 long, spans {SPANS}")


def _cells(pieces: DataFrame, cell: int, law: Law) -> DataFrame:
    """gram, c1, c2 of each piece and, for each cell of window starts that it reaches, the key of
    the cell (k0), the context cut to it (k1, k2), before, rows and piece."""
    names, u = [*CONTEXT, "k0", "k1", "k2", "before", "lo", "hi"], law.unit

    def run(batches):
        for batch in batches:
            rows, cuts, texts = [], [], []
            for *who, before, low_row, high_row, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                least = before - (len(text) // u - law.length)
                for c in range(least // cell, before // cell + 1):
                    low, high = max(least, c * cell), min(before, c * cell + cell - 1)
                    # What all windows of the cell share, whether the piece has them or not.
                    key = text[(before - c * cell) * u : (before - c * cell - cell + 1 + law.length) * u]
                    rows.append((*who, xxhash.xxh3_64_intdigest(key, seed=c * cell) - (1 << 63), high, low_row, high_row))
                    texts.append(text[(before - high) * u : (before - low + law.length) * u])
                    cuts.append(xxhash.xxh3_128_digest(texts[-1], seed=high))
            who = np.array(rows, dtype=np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*who[:4], *_halves(cuts), *who[4:])] + [pa.array(texts, pa.binary())], names=[*names, "piece"])

    return pieces.select(*PIECE).mapInArrow(run, ", ".join(f"{n} long" for n in names) + ", piece binary")


def _whole(contexts: DataFrame, before, after, law: Law) -> DataFrame:
    """The span of each context that is a repeat as it is: found twice or more, or in two rows."""
    again = F.col("lo") != F.col("hi") if law.across else F.col("n") > 1
    return contexts.filter(again).select(*CONTEXT, F.array(F.struct((-before).cast("long").alias("a"), after.cast("long").alias("b"))).alias("spans"))


def _repeats(pieces: DataFrame, cell: int, bucket: int, law: Law) -> DataFrame:
    """gram, c1, c2, spans of pieces (saved, no context twice) of K-grams of more than one context. cell: window starts that their K-grams stand for."""
    many = saved(pieces.groupBy("gram").count().filter(F.col("count") > bucket).select("gram"), "many")
    if many.isEmpty():
        return _trees(pieces, law)
    many, cell = small_side(many), -(-cell // SPLIT)
    cut = saved(_cells(pieces.join(many, "gram", "left_semi"), cell, law), "cells")
    keys = {"k0": "gram", "k1": "c1", "k2": "c2"}
    # The pieces of one context are equal, as are what stands before.
    unique = cut.groupBy(*keys).agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("before").alias("before"), F.first("piece").alias("piece"))
    unique = saved(unique.withColumnsRenamed(keys), "split")
    inner = _repeats(saved(_shared(unique).select(*PIECE), "pieces"), cell, bucket, law)
    after = F.octet_length("piece") / law.unit - F.col("before")
    inner = inner.unionByName(_whole(unique, F.col("before"), after, law))
    found = cut.select(*CONTEXT, *keys).join(inner.withColumnsRenamed({v: k for k, v in keys.items()}), list(keys)).select(*CONTEXT, "spans")
    return _trees(pieces.join(many, "gram", "left_anti"), law).unionByName(found)


def _shared(contexts: DataFrame) -> DataFrame:
    """The contexts whose K-gram has others."""
    several = saved(contexts.groupBy("gram").count().filter("count > 1").select("gram"), "several")
    return contexts.join(small_side(several), "gram", "left_semi")


def _relative(base: DataFrame, law: Law, bucket: int) -> tuple[DataFrame, DataFrame]:
    """The anchors of all rows, and gram, c1, c2, spans of the contexts that have repeats. base: see _row()."""
    found = saved(_occurrences(base, law), "anchors")
    # Equal contexts have equal lengths before and after; any place of theirs stands for all.
    one = [F.first(c).alias(c) for c in ("gram", *ROW, "at", "before", "after")]
    unique = saved(found.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.min("_row").alias("lo"), F.max("_row").alias("hi"), *one), "contexts")

    # Each row that stands for a context is read once, with the list of its places.
    lists = _shared(unique).groupBy(*ROW).agg(F.collect_list(F.struct(*CONTEXT, "at", "before", "after", "lo", "hi")).alias("list"))
    lists = saved(lists, "places").withColumnsRenamed({"_row": "_r", "_crc": "_c"})
    same = lambda df: (base["_row"] == df["_r"]) & (base["_crc"] == df["_c"])
    texts, keys = base.select(*ROW, "text"), lists.select("_r", "_c")
    if fits(keys):  # then only the texts that are wanted are exchanged
        texts = texts.join(F.broadcast(keys), same(keys), "left_semi")
    pieces = saved(_pieces(texts.join(lists, same(lists)).select("text", "list"), law), "pieces")
    return found, _repeats(pieces, law.length - law.gram + 1, bucket, law).unionByName(_whole(unique, F.col("before"), F.col("after"), law))


def spans(base: DataFrame, law: Law = BYTES, bucket: int = BUCKET) -> DataFrame:
    """_row, _crc and the repeated spans, array<struct<a, b>> in symbols, of each different row that has any."""
    found, each = _relative(base, law, bucket)
    each = _merged(each.groupBy("c1", "c2").agg(F.flatten(F.collect_list("spans")).alias("spans")), ["c1", "c2"])
    moved = F.transform("spans", lambda s: F.struct((F.col("at") + s["a"]).alias("a"), (F.col("at") + s["b"]).alias("b")))
    placed = found.select(*ROW, "c1", "c2", "at").join(saved(each, "relative"), ["c1", "c2"]).select(*ROW, moved.alias("spans"))
    return _merged(placed.groupBy(*ROW).agg(F.flatten(F.collect_set("spans")).alias("spans")), ROW)


def with_passages(base: DataFrame, law: Law = WORDS, bucket: int = BUCKET) -> DataFrame:
    """_row, _crc of the rows that have a passage of law.length words that another document has too."""
    found, each = _relative(base, law, bucket)
    return found.select(*ROW, "c1", "c2").join(saved(each.select("c1", "c2").distinct(), "passages"), ["c1", "c2"], "left_semi").select(*ROW).distinct()


def _merged(df: DataFrame, keys: list[str]) -> DataFrame:
    """df (keys of long, and spans) with the spans that meet as one."""

    def run(batches):
        for batch in batches:
            lists = batch.column(len(keys))
            flat, ends = lists.flatten(), np.cumsum([0, *lists.value_lengths().to_pylist()])
            a, b = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            each = [joined(zip(a[i:j].tolist(), b[i:j].tolist(), strict=True)) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], _spans_array(each)], names=batch.schema.names)

    return df.mapInArrow(run, ", ".join(f"{k} long" for k in keys) + f", spans {SPANS}")


def cut(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """doc_id, the bytes kept, the spans removed, n_bytes and the row's hashes of each document."""
    base = _row(docs)
    removed = small_side(saved(spans(base, bucket=bucket), "removed")).withColumnsRenamed({"_row": "_r", "_crc": "_c"})
    both = base.join(removed, (base["_row"] == removed["_r"]) & (base["_crc"] == removed["_c"]), "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "spans", *ROW)

    def run(batches):
        for batch in batches:
            kept, sizes = [], []
            for text, gone in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ends = [0, *(x for s in gone or () for x in (s["a"], s["b"])), len(text)]
                kept.append(b"".join(text[i:j] for i, j in zip(ends[::2], ends[1::2], strict=True)))
                sizes.append(len(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), batch.column(2), pa.array(sizes, pa.int64()), *batch.columns[3:]], names=["doc_id", "kept", "removed", "n_bytes", *ROW])

    return both.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, kept binary, removed {SPANS}, n_bytes long, _row long, _crc long")


def digests(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """The contract's columns, and has_passage: whether WORDS.length words in a row are in another document too."""
    docs, spark = docs.select("doc_id", "text"), docs.sparkSession
    with kept_after(spark, "passages") as keep:
        held = keep(with_passages(_row(docs), bucket=bucket))
    held = small_side(held).withColumnsRenamed({"_row": "_r", "_crc": "_c"})
    done = cut(docs, bucket).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        *ROW,
    )
    both = done.join(held, (done["_row"] == held["_r"]) & (done["_crc"] == held["_c"]), "left")
    return both.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("_r").isNotNull().alias("has_passage"))
