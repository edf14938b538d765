"""Secrets, manifests and clusters against brute force, on odd, empty, long and clashing tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

from inkwell.llm import centroids, merkle, queries, secret_scan

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, DATA), connect(DATA), queries.ORACLE_SQL[name]) == []


def brute_secrets(text):
    words = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
    out = [("assign", *m.span()) for m in re.finditer(rf"({words})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))


def test_secret_base_spans():
    rnd = random.Random(1)
    parts = ["token", "Secret", "api_key", "APIKEY", "passwd", "password", "=", ":", " ", "'", '"', "AKIA", "ABCD12345", "AKIA0", "deadbeef", "0123abcd", "é", "K", "\n", "z", "+", "/", "toKen", "tokeſn"]
    for _ in range(8000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert [s for s in secret_scan.secrets(t) if s[0] != "entropy"] == brute_secrets(t)


ALPHABETS = {"lower_hex": "0123456789abcdef", "upper_hex": "0123456789ABCDEF", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "lower": "abcdefghijklmnopqrstuvwxyz0123456789", "mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"}


@pytest.mark.parametrize("kind", secret_scan.CLASSES, ids=lambda c: c.name)
def test_windows_count_as_by_hand(kind):
    rnd, random_found = random.Random(2), 0
    for _ in range(400):
        letters = rnd.sample(ALPHABETS[kind.name], rnd.randint(2, len(ALPHABETS[kind.name])))
        said = "".join(rnd.choice(letters) for _ in range(rnd.randint(kind.window, 90)))
        want = []
        for a in range(len(said) - kind.window + 1):
            w = said[a : a + kind.window]
            bits = -sum(w.count(c) / kind.window * math.log2(w.count(c) / kind.window) for c in set(w))
            upper, lower, digits = (sum(f(c) for c in w) for f in (str.isupper, str.islower, str.isdigit))
            if bits >= kind.threshold - 1e-12 and digits >= kind.digits and upper + lower >= kind.letters and (upper and lower or not kind.cases):
                if want and a <= want[-1][1]:
                    want[-1] = (want[-1][0], a + kind.window)
                else:
                    want.append((a, a + kind.window))
        assert secret_scan.hot_windows(said, kind) == want
        random_found += bool(secret_scan.hot_windows("".join(rnd.choice(ALPHABETS[kind.name]) for _ in range(kind.window + 8)), kind))
    assert random_found > 0.85 * 400


def test_entropy_and_allow_list():
    key = "Zx8Qp2Lm9Vt4Rk7Wn3Bc6Yd1"
    found = lambda t, **k: [t[a:b] for kind, a, b in secret_scan.secrets(t, **k) if kind == "entropy"]
    assert found(f"é key {key}.") == [key] and found(f"{key} {key}") == [key, key]
    assert found(f"key {key}", allow=frozenset([key])) == []
    for calm in ("getUserAccountInformationFromTheDatabaseConnectionPool", "550e8400-e29b-41d4-a716-446655440000", f"https://x.org/{key}", f"example_{key}", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1b", "/usr/local/lib/python/site-packages/numpy", "20240101120000202401011200002024"):
        assert found(f"see {calm} there") == []
    # What a base span holds is reported once.
    assert secret_scan.secrets(f"token = {key}") == [("assign", 0, len(key) + 8)]
    long = "b " * 600_000 + key + " c" * 10
    assert found(long) == [key]
    assert len(found("".join(random.Random(1).choices(ALPHABETS["mixed"], k=400_000)))) > 100
    cover = secret_scan.Cover([(5, 9), (0, 3), (6, 7), (20, 30)])
    for a in range(32):
        for b in range(a + 1, 32):
            assert cover.holds(a, b) == any(x <= a and b <= y for x, y in [(5, 9), (0, 3), (20, 30)])
            assert cover.meets(a, b) == any(x < b and a < y for x, y in [(5, 9), (0, 3), (20, 30)])


def test_secret_digests(spark):
    key = "Zx8Qp2Lm9Vt4Rk7Wn3Bc6Yd1"
    texts = [None, "", f"x {key} token: abcdefgh9 " + "0a" * 16, "AKIA" + "B" * 12, "ü" * 3 + " secret='short' " + key]
    rows = [(i, t, "own") for i, t in enumerate(texts)] + [(2, texts[2], "own"), (None, texts[3], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(3)
    got = sorted(map(tuple, secret_scan.digests(docs).collect()), key=repr)
    want = []
    for i, t, _ in rows:
        base, spans = brute_secrets(t or ""), secret_scan.secrets(t or "")
        say = lambda x: ",".join(f"{k}:{a}:{b}" for k, a, b in x)
        want.append((i, *(sum(s[0] == k for s in base) for k in secret_scan.KINDS), hashlib.sha256(say(base).encode()).hexdigest(), say(spans), len(spans) - len(base)))
    assert got == sorted(want, key=repr) and sum(w[-1] for w in want) == 3
    assert secret_scan.digests(docs.filter("false")).count() == 0


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def said(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_manifest(rows, arity=16):
    leaves, paths, groups, sub = [sha("".join(map(said, r))) for r in rows], {k: [] for k in range(len(rows))}, {}, {}
    for k, r in enumerate(rows):
        groups.setdefault(r[1], []).append(k)

    def tree(nodes):
        while len(nodes) > 1:
            runs = [nodes[a : a + arity] for a in range(0, len(nodes), arity)]
            for run in runs:
                for j, (_, below) in enumerate(run):
                    for k in below:
                        paths[k].append(([d for d, _ in run], j))
            nodes = [(sha("".join(d for d, _ in run)), [k for _, below in run for k in below]) for run in runs]
        return nodes[0]

    subroots = []
    for g in sorted(groups, key=lambda g: (g is not None, (g or "").encode())):
        ks = sorted(groups[g], key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, leaves[k]))
        subroots.append(tree([(leaves[k], [k]) for k in ks]))
        sub |= dict.fromkeys(ks, subroots[-1][0])
    root, out = tree(subroots)[0], []
    for k, r in enumerate(rows):
        own = leaves[k]
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
            own = sha("".join(map(said, (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))))
        beside = "".join(d for run, j in paths[k] for i, d in enumerate(run) if i != j)
        for run, j in paths[k]:
            own = sha("".join([*run[:j], own, *run[j + 1 :]]))
        out.append((r[0], leaves[k], sub[k], root, sha(beside), own, own == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def manifest_rows():
    rnd = random.Random(1)
    rows = [(i, rnd.choice([None, "a", "b", "é"]), "en", 3, rnd.choice(["Abc", None, "", "x y Ä Z"])) for i in range(700)]
    rows += [(i, f"s{i % 40}", None, None, "T" * (i % 7)) for i in range(700, 1000)] + [(3, "a", "en", 3, "dup")] * 3
    return [*rows, (None, "a", None, None, None), (5000, "lone", "x", 1, "Q"), (5001, "", "x", 1, "Long Text " * 200_000)]


@pytest.mark.parametrize("take", [slice(None), slice(0, 0), slice(0, 1), slice(0, 17), slice(699, 760)])
def test_manifest(spark, take):
    rows = manifest_rows()[take]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit("own") for c in ("leaf", "tree", "at", "held", "group", "id", "shown")})
    assert sorted(map(tuple, merkle.digests(docs).collect()), key=repr) == (brute_manifest(rows) if rows else [])


def test_manifest_of_pairs(spark):
    """Deep trees: two children a parent, and frontiers that meet a level at a time."""
    rows = [(i, "one" if i % 3 else "two", None, None, str(i)) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = merkle.proofs(docs, arity=2).withColumn("again", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    want = {r[0]: r for r in brute_manifest(rows, arity=2)}
    assert all((r.leaf, r.subroot, r.root) == want[r.id][1:4] and r.again == r.root for r in got) and len(got) == 300
    leaves = spark.createDataFrame([(0, 300, i, sha(str(i))) for i in range(300)], "tree long, size long, at long, digest string").repartition(11)
    nodes = {(r.level, r.at): r.digest for r in merkle.build(leaves, arity=2, stride=1).collect()}
    level = [sha(str(i)) for i in range(300)]
    for k in range(1, 10):
        level = [sha("".join(level[a : a + 2])) for a in range(0, len(level), 2)]
        assert level == [nodes[k, i] for i in range(len(level))]
    assert len(level) == 1


def brute_clusters(rows, k=40, rounds=5, dims=64):
    whole = lambda v: v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    known = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if whole(v)]
    first = sorted(known, key=lambda r: (r[0] is None, sha(f"2:{r[0]}"), r[1]))[:k]
    centres = [list(v) for _, v in first]
    if not known:
        return []

    def near():
        far = [[sum((x - y) ** 2 for x, y in zip(v, c, strict=True)) for c in centres] for _, v in known]
        return [(min(d), d.index(min(d))) for d in far]

    for _ in range(rounds):
        own = near()
        for q in range(len(centres)):
            of = [v for (_, v), (_, c) in zip(known, own, strict=True) if c == q]
            if of:
                centres[q] = [sum(x) // len(of) for x in zip(*of, strict=True)]
    own = near()
    inertia = [sum(d for d, c in own if c == q) for q in range(len(centres))]
    return sorted(((i, c, d, inertia[c], sum(inertia), sha(",".join(map(str, centres[c])))) for (i, _), (d, c) in zip(known, own, strict=True)), key=repr)


def vector_rows():
    rnd = random.Random(2)
    rows = [(i, [rnd.choice([-1.0, 0.0, 0.5]) for _ in range(64)] if i % 3 else [float(rnd.randint(0, 2))] * 64) for i in range(120)]
    rows += [(200 + i, [rnd.gauss(i % 5, 0.3) for _ in range(64)]) for i in range(200)]
    rows += [(None, [0.25] * 64), (7, None), (8, [1.0] * 63), (9, [None] + [1.0] * 63), (10, [math.nan] + [1.0] * 63), (11, [math.inf] + [1.0] * 63)]
    return [*rows, (3, [0.1] * 64), (3, [0.1] * 64), (4, [1000.0] * 64), (12, [])]


@pytest.mark.parametrize("take", [slice(None), slice(0, 0), slice(0, 1), slice(0, 5)])
def test_clusters(spark, take):
    rows = vector_rows()[take]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).withColumns({c: F.lit("own") for c in ("v", "cluster", "upper", "h")})
    assert sorted(map(tuple, centroids.digests(vectors).collect()), key=repr) == brute_clusters(rows)


def test_far_components_are_an_error(spark):
    vectors = spark.createDataFrame([(1, [1e7] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="component beyond"):
        centroids.digests(vectors).collect()


def test_bounds_spare_scans():
    """Bounds give what a scan of all gives, and most vectors are not scanned again."""
    rnd = np.random.default_rng(4)
    middle = rnd.integers(-2000, 2000, (8, 16))
    v = (middle[rnd.integers(0, 8, 3000)] + rnd.integers(-150, 150, (3000, 16))).astype(np.int64)
    centres, moved, state, scanned = v[:8].copy(), None, (None, None, None), []
    for _ in range(8):
        *state, n = centroids.assign(v, *state, centres, moved)
        scanned.append(n)
        own, first, second = centroids.nearest(v, centres)
        assert (state[0] == own).all() and (state[1] >= np.sqrt(first)).all() and (state[2] <= np.sqrt(second)).all()
        new = np.array([v[own == c].sum(0) // max((own == c).sum(), 1) if (own == c).any() else centres[c] for c in range(8)])
        moved, centres = centroids.Moved(centres, new), new
    assert scanned[0] == 3000 and sum(scanned[1:]) < 0.5 * 3000 * 7
