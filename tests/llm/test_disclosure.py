"""Terms that give entities away, against counts by hand on a planted corpus."""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict

import pytest

from inkwell.llm import pii
from inkwell.llm.common import keyed

TERMS = lambda t: set(re.findall(r"[^\W\d_]{3,}", t.lower()))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(9)
    words = ["".join(rnd.choice("aeioudlnrst") for _ in range(rnd.randint(3, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    out = [prose(rnd.randint(5, 60)) for _ in range(300)]
    out += [f"{prose(12)} Zebulon at zeb@north.org {prose(11)}" for _ in range(2)]  # a name beside an address in two texts
    out += [f"{prose(12)} Quentin at q.q@south.org {prose(11)}" for _ in range(6)] + [f"{prose(9)} quentin {prose(9)}"] * 2
    out += [f"{prose(4)} Yolanda {prose(k)} at y{k}@west.org {prose(9)}" for k in range(4)]  # one domain, four owners
    copied = f"{prose(12)} Oswald at o@east.org"
    out += [f"{copied} {prose(11)}" for _ in range(3)]  # copies up to the address count once
    out += [f"{prose(10)} +1 (234) 555-6789 {prose(10)} 10.2.3.{k}" for k in range(3)]
    return [(k // 2 * 2 if k > 320 else k, t) for k, t in enumerate(out)] + [(900, None), (901, ""), (0, out[0]), (902, "Xavier x@y.zz")]


def brute(rows, window, chance):
    seen, docs = [], {(i, t or "") for i, t in rows}
    for i, t in docs:
        for kind, a, b in pii.base_spans(t):
            left, right = t[:a].split()[-window:], t[b:].split()[:window]
            both = tuple(left + ["|"] + right)
            sides = [tuple(s) if len(s) == window else both for s in (left, right)]
            for e in pii.entities(kind, t[a:b]):
                seen.append(((i, t), e, *sides, TERMS(" ".join(left)) | TERMS(" ".join(right))))
    n, n_t, n_e, pairs = len(rows), defaultdict(int), defaultdict(set), defaultdict(list)
    for _, t in rows:
        for x in TERMS(t or ""):
            n_t[x] += 1
    for doc, e, left, right, terms in seen:
        n_e[e].add(doc)
        for x in terms:
            pairs[e, x].append((doc, left, right))
    out = {}
    for (e, x), found in pairs.items():
        c, both = min(len({f[k] for f in found}) for k in range(3)), len({f[0] for f in found})
        ne, nt = len(n_e[e]), max(n_t[x], both)
        p = c * math.log(ne * nt / n) - (c * math.log(c) - c + math.log(2 * math.pi * c) / 2)
        if c > 1 and ne < n and p + math.log(len(pairs)) <= math.log(chance):
            out[e, x] = math.log2(n * both / (ne * nt)) / math.log2(n / ne)
    return out


@pytest.mark.parametrize(("window", "chance"), [(8, 0.05), (3, 0.5)])
def test_disclosures_as_by_hand(spark, rows, window, chance):
    docs = keyed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = {(r.entity, r.term): r.disclosure for r in pii.disclosures(docs, pii.mentions(docs, window), chance).collect()}
    want = brute(rows, window, chance)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    if window == 8:
        assert {("email:zeb@north.org", "zebulon"), ("email:q.q@south.org", "quentin"), ("domain:west.org", "yolanda")} <= want.keys() and not any(x == "oswald" for _, x in want)


def test_two_contexts_can_pass(spark):
    rows = [(i, f"filler{i % 7} Quentin {'ab'[i] * 4} wrote to q@x.org about {'hi'[i] * 5} today") for i in range(2)]
    rows += [(100 + i, "nothing wrote to see here about today and some more") for i in range(300)]
    got = {r.doc_id: r.spans for r in pii.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("email:30:37" in got[i] and "term:8:15" in got[i] for i in range(2)) and not any(got[100 + i] for i in range(300))
