"""The operators against brute force on small tables with odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import bpe, decontamination, langid, pii, quality_classifier, quality_rules, repeats, sharding, simhash, token_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, _key string"


@pytest.fixture(scope="module")
def odd(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdéß.,1X") for _ in range(rnd.randint(1, 9)))
    texts = [None, "", "   \n\t ", "one", "one two", "a.b@c.de x +1 (234) 555-6789 x 10.0.0.256 x 4111 1111 1111 1111", "<|endoftext|> it's  x\n\n y", "ab" * 3000]
    texts += [" ".join(word() for _ in range(rnd.randint(3, 300))) for _ in range(40)]
    texts += texts[8:12] + [texts[8] + " more"]
    texts.append(" ".join(word() for _ in range(200_000)))  # 1.2 MB
    rows = [(i, t, "en", "s", len(t or ""), True, "k") for i, t in enumerate(texts)]
    rows += [(3, "one", "en", "s", 3, True, "k"), (None, "no id", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


#: Names that operators might use for themselves, with values of the caller's.
CLASHES = {n: f"own {n}" for n in "_key _no _h _id _k _i _row _text _w fp spans found sanitised n_words kept hash item_id text_crc32 size lang_pred score count n _n".split()}


def clashing(df):
    """df with columns of such names; what returns the caller's columns must leave their values as they are."""
    return df.drop("kept", "_key").withColumns({k: F.lit(v) for k, v in CLASHES.items()})


def of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_bpe_matches_library(odd):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(bpe.default_vocabulary())
    want = Counter()
    for i, t in of(odd):
        ids = model.encode(t or "", add_special_tokens=False).ids
        back = model.decode(ids, skip_special_tokens=False)
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in bpe.digests(odd).collect()) == want
    assert bpe.digests(odd.filter("false")).count() == 0


def test_token_files(odd):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(token_files.default_vocabulary())
    got = token_files.digests(odd).collect()
    want = Counter((i, zlib.crc32(np.array([*model.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes())) for i, t in of(odd))
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.start)):
        assert r.start == at
        at += r.n_tokens
    assert token_files.digests(odd.filter("false")).count() == 0


def test_pack_round_trip():
    rnd = np.random.default_rng(1)
    for sizes in ([], [0], [1], [4, 0, 5], [0, 0, 1000, 3], rnd.integers(0, 9, 300).tolist()):
        n = np.array(sizes, dtype=np.int64)
        x = (rnd.integers(0, 1 << 32, n.sum()) >> rnd.integers(0, 32, n.sum())).astype(np.uint32)
        packed = token_files.pack(x, n)
        assert len(packed) == len(n)
        assert (token_files.unpack(b"".join(c for c, _ in packed), b"".join(d for _, d in packed), n) == x).all()
        for (c, d), own in zip(packed, np.split(x, np.cumsum(n)[:-1]) if len(n) else [], strict=True):
            assert (token_files.unpack(c, d, np.array([len(own)])) == own).all()


def test_simhash_components(odd):
    got = simhash.digests(odd).collect()
    prints = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got]
    nodes = sorted({p for _, p, _ in prints})
    root = {p: p for p in nodes}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in nodes:
        for b in nodes:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for i, p, _ in prints:
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    assert all(c == least.get(find(p)) for _, p, c in prints)
    assert simhash.digests(odd.filter("false")).count() == 0


def test_golay_keys_meet():
    rnd = np.random.default_rng(2)
    x = rnd.integers(0, 1 << 63, 400).astype(np.uint64)
    for errors in range(4):
        y = x.copy()
        for k in range(len(y)):
            for b in rnd.choice(64, errors, replace=False):
                y[k] ^= np.uint64(1 << int(b))
        keys = [set(zip(*(a.tolist() for a in simhash.fuzzy_keys(v.view(np.int64))), strict=True)) for v in (x, y)]
        left = {(r, k) for r, k, s in keys[0] if s == 0}
        right = {(r, k) for r, k, s in keys[1] if s == 1}
        assert {r for r, _ in left & right} == set(range(400))


def test_sharding(odd):
    got = sharding.shard(odd).collect()
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes[k] for k in range(24)) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in of(odd))
    for n in (1, 2, 5, 1000):
        assert sorted(sharding.permute(np.arange(n), n)) == list(range(n))
        assert [sharding.permute(sharding.permute(np.arange(n), n), n, back=True).tolist()] == [list(range(n))]
    assert sharding.shard(odd.filter("false")).count() == 0


def test_quality_rules(odd):
    want = Counter()
    for i, t in of(odd):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {k + j for k in range(len(w) - 2) if n[tuple(w[k : k + 3])] > 1 for j in range(3)}
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again), failed)] += 1
    got = quality_rules.digests(odd).collect()
    assert Counter(tuple(r)[:7] for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    assert quality_rules.passed(odd).columns == odd.columns


def test_pii_spans(odd):
    rnd = random.Random(1)
    for _ in range(3000):
        t = "".join(rnd.choice("a@.-+12 (%") for _ in range(rnd.randint(0, 25)))
        own = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        assert [s for s in pii.base_spans(t) if s[0] == "email"] == own
    rows = {r.doc_id: r for r in pii.digests(odd).collect()}
    assert (rows[5].n_email, rows[5].n_ip, rows[5].n_card, rows[5].n_phone) == (1, 0, 1, 1)
    assert rows[0].spans == ""
    assert pii.sanitise(odd).columns == odd.columns


def test_pii_terms(spark):
    rows = [(i, f"filler{i % 7} Quentin {'abcdefg'[i] * 4} wrote to q@x.org about {'hijklmn'[i] * 5} today") for i in range(7)]
    rows += [(100 + i, "nothing wrote to see here about today and some more") for i in range(200)]
    got = {r.doc_id: r.spans for r in pii.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("term:" in got[i] for i in range(7))
    assert all(got[100 + i] == "" for i in range(200))


def test_decontamination(spark):
    item = "A train leaves Boston at 10 km and meets Alice with 10 apples, then Alice pays 25 dollars for 10 tickets to see Boston again today."
    bench = spark.createDataFrame([(1, item), (2, "too short"), (3, None)], "item_id long, text string")
    other = item.replace("Boston", "Paris").replace("Alice", "Bob").replace("10", "17").replace("25", "99")
    broken = other.replace("17 apples", "18 apples").replace("17 tickets", "19 tickets").replace("Paris again", "Rome again")
    docs = spark.createDataFrame([(1, "Filler. " + other + " More."), (1, "clean"), (2, broken), (3, None), (None, item), (4, "")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()} == {(1, 1), (None, 1)}
    assert sorted((r.doc_id, r.text or "") for r in decontamination.clean(docs, bench).collect()) == [(1, "clean"), (2, broken), (3, ""), (4, "")]
    assert decontamination.contaminated(docs.filter("false"), bench).count() == 0
    assert decontamination.contaminated(docs, bench.filter("false")).count() == 0


def test_decontamination_at_any_place(spark):
    items = {1: "compute the square root of some large even", 2: "Is 3 4 5 6 8 or 9 when x is 2", 3: "one two three four five six seven eight nine ten eleven twelve thirteen"}
    copies = {**items, 3: " ".join(items[3].split()[:10])}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    docs = spark.createDataFrame([(10 * k + i, "filler " * k + ". " + t + " . more words here") for k in range(8) for i, t in copies.items()], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()} == {(10 * k + i, i) for k in range(8) for i in items}


def test_decontamination_names(spark):
    bench = spark.createDataFrame([(1, "What is the capital of France?"), (2, "Alice bought nine red apples at the market")], "item_id long, text string")
    rows = [(1, "Question: What is the capital of France?"), (1, "so What is the capital of Spain"), (1, "WHAT IS THE CAPITAL OF FRANCE"), (1, "tell me what is the capital of france now")]
    rows += [(2, "Some text. Bob bought nine red apples at the market."), (2, "then Bob bought nine red apples at the market"), (2, "alice bought nine red apples at the market"), (2, "ALICE BOUGHT NINE RED APPLES AT THE MARKET")]
    rows += [(0, "Clearly Berlin is the capital of Germany"), (0, "what is the capital of trade")]
    docs = spark.createDataFrame([(10 * k + i, t) for k, (i, t) in enumerate(rows)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()} == {(10 * k + i, i) for k, (i, _) in enumerate(rows) if i}


def test_decontamination_few_literals(spark):
    items = {1: "What is 12 + 7 + 5?", 2: "What is DNA?", 3: "12 7 5 19 23 44 8 61 70 81 92 13 34 55", 4: "Seven", 5: "Define entropy", 6: "3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 find the next number in this row now"}
    copies = {**items, 6: items[6].replace("15 16 17 18", "19 16 12 18")}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows = [(10 * k + i, "filler " * k + "\n" + t + ("\nmore words" if k else "")) for k in range(3) for i, t in copies.items() if i != 4 or not k]
    rows += [(100, "What is 12 + 7 + 6?"), (101, "what is rna"), (102, "12 7 5 19 23 45 8 61 70 81 92 13 34 55"), (103, "seven more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()}
    assert got == {(i, i % 10) for i, _ in rows if i < 100}


@pytest.mark.parametrize("bucket", [repeats.BUCKET, 3])
def test_repeats(spark, bucket):
    rnd = random.Random(3)
    w = lambda n: "".join(rnd.choice("abcdé ") for _ in range(n))
    p, q = w(500), w(900)
    rows = [(1, p + w(50)), (2, w(30) + p), (3, "a" * 3000), (4, None), (5, ""), (9, q), (9, q), (10, q[200:700] + w(100) + q[300:800]), (11, "ab" * 900 + w(5)), (None, w(800))]
    for i in range(20):
        t = list(p)
        t[rnd.randrange(500)] = "Z"
        rows.append((100 + i, w(rnd.randint(0, 300)) + "".join(t) + w(rnd.randint(0, 300))))
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[k : k + 400] for t in texts for k in range(len(t) - 399))
    want = Counter()
    for (i, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), dtype=bool)
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                gone[k : k + 400] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        want[(i, len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest())] += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(tuple(r)[:5] for r in repeats.digests(docs, bucket).collect()) == want


@pytest.mark.parametrize("bucket", [repeats.BUCKET, 3])
def test_passages(spark, bucket):
    rnd = random.Random(4)
    w = lambda n: [rnd.choice("ab cd efg hi j klm no".split()) + str(rnd.randrange(40)) for _ in range(n)]
    p, again = w(60), w(55)
    rows = [(1, w(20) + p + w(9)), (2, p), (3, w(300)), (4, again + w(5) + again), (5, p[:49] + w(30)), (6, None), (7, []), (8, w(70)), (8, w(70))]
    rows += [(100 + i, w(rnd.randrange(90)) + p[5:] + w(rnd.randrange(90))) for i in range(12)] + [(200, p[10:] + ["x"])]
    made = [(i, None if x is None else " ".join(x)) for i, x in rows]
    where = {}
    for k, (_, t) in enumerate(made):
        x = (t or "").split()
        for j in range(len(x) - 49):
            where.setdefault(tuple(x[j : j + 50]), set()).add(k)
    want = Counter((i, any(len(where[tuple((t or "").split()[j : j + 50])]) > 1 for j in range(len((t or "").split()) - 49))) for i, t in made)
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    assert Counter((r.doc_id, r.has_passage) for r in repeats.digests(docs, bucket).collect()) == want


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = [r for r in langid.identify(docs).collect() if r.held_out]
    assert got and sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.95 * len(got)
    blank = spark.createDataFrame([(1, None, None), (2, "123 456", "en")], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in langid.identify(blank).collect()} == {("und", 0.0)}


def test_quality_classifier(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = {r.doc_id: r for r in labels.filter("doc_id % 4 = 0").collect()}
    got = {r.doc_id: r for r in quality_classifier.classify(docs, labels.filter("doc_id % 4 <> 0")).collect()}
    good = [got[i].expected_grade for i, r in held.items() if r.quality == 1 and r.toxic == 0]
    bad = [got[i].expected_grade for i, r in held.items() if r.quality == 0 or r.toxic == 1]
    assert np.mean(good) > np.mean(bad) + 0.3
    empty = quality_classifier.classify(spark.createDataFrame([(1, None)], "doc_id long, text string"), labels.filter("false")).collect()
    assert [(r.expected_grade, r.p_top, r.kept) for r in empty] == [(0.0, 0.0, False)]


def test_every_operator_on_an_empty_table(nothing, spark):
    bench = spark.createDataFrame([(1, "What is the capital of France and of Spain then?")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    made = [bpe.digests(nothing), token_files.digests(nothing), simhash.digests(nothing), sharding.shard(nothing), quality_rules.digests(nothing), pii.digests(nothing)]
    made += [repeats.digests(nothing), langid.identify(nothing), quality_classifier.classify(nothing, labels), decontamination.contaminated(nothing, bench)]
    made += [quality_rules.passed(nothing), simhash.representatives(nothing), decontamination.clean(nothing, bench), pii.sanitise(nothing)]
    assert [m.count() for m in made] == [0] * len(made)


def test_columns_of_the_caller(odd, spark):
    wide = clashing(odd).filter("length(text) < 100000 or text is null")
    bench = spark.createDataFrame([(1, "What is the capital of France and of Spain then?")], "item_id long, text string")
    for out in (quality_rules.passed(wide), simhash.representatives(wide), decontamination.clean(wide, bench), pii.sanitise(wide)):
        assert out.columns == wide.columns
        rows = out.collect()
        assert all(r[k] == v for r in rows for k, v in CLASHES.items())
    assert len(pii.sanitise(wide).collect()) == wide.count() == len(decontamination.clean(wide, bench).collect())
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    n = wide.count()
    made = [bpe.digests(wide), token_files.digests(wide), simhash.digests(wide), sharding.shard(wide), quality_rules.digests(wide), pii.digests(wide), repeats.digests(wide), langid.identify(wide), quality_classifier.classify(wide, labels)]
    assert [m.count() for m in made] == [n] * len(made)


def words3(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def test_fingerprints(odd):
    import xxhash

    want = Counter()
    for i, t in of(odd):
        w = words3(t or "")
        grams = [" ".join(w)] if 0 < len(w) < 3 else [" ".join(w[k : k + 3]) for k in range(len(w) - 2)]
        ones = [0] * 64
        for g in grams:
            h = xxhash.xxh64_intdigest(g.encode(), seed=42)
            for b in range(64):
                ones[b] += h >> b & 1
        want[(i, format(sum(1 << b for b in range(64) if 2 * ones[b] > len(grams)), "016x"))] += 1
    assert Counter((r.doc_id, r.fingerprint) for r in simhash.digests(odd).collect()) == want


def test_representatives(spark):
    rows = [(5, "a b c d e f", "x"), (4, "a b c d e f", "y"), (4, "a b c d e f", "y"), (4, "a b c d e f", "z"), (None, "a b c d e f", "n"), (7, None, "e"), (6, "", "e"), (8, "quite another text here", "q")]
    got = [tuple(r) for r in simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()]
    assert sorted((r[0], r[1]) for r in got) == [(4, "a b c d e f"), (6, ""), (8, "quite another text here")]


def brute_spans(t):
    out = []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_pii_kinds(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("0123456789. -+()@ax") for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    texts += ["4111 1111 1111 1111", "4111-1111-1111-1111x", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.3.255", "+49 (0)30 123456", "é 10.0.0.1 ü a@b.c", "8.8.8.8 a.b@c.d +1 377 555 0271"]
    assert all(pii.base_spans(t) == brute_spans(t) for t in texts)
    rows = list(enumerate(texts[-300:]))
    for r in pii.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        own = brute_spans(rows[r.doc_id][1])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in own).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in own) for k in pii.KINDS]


def test_pii_window_is_of_words():
    long = "x" * 500
    near = list(pii.contexts(f"one {long} two a@b.co three {long} four", 2))
    assert near[0][2] == f"{long} two\nthree {long}"
    assert pii.entities("email", "Ann.Lee7@X.org") == ["email:ann.lee7@x.org", "domain:x.org", "owner:ann lee"]


def test_sharding_goes_back(odd):
    one, two = (sorted(map(tuple, sharding.shard(odd).collect()), key=repr) for _ in range(2))
    assert one == two
    rows = sharding.shard(odd).collect()
    assert all(sharding.row_of(r.shard, r.slot, len(rows), 24) == r.row_number for r in rows)


def js(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    side = lambda x: sum(a * math.log2(a / c) for a, c in zip(x, m, strict=True) if a > 0)
    return (side(p) + side(q)) / 2


def test_quality_distances(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    known = {r["lang"]: r for r in quality_rules.references(docs)}
    assert "en" in known
    counts = Counter()
    for r in docs.filter("lang = 'en'").collect():
        counts.update(w for w in re.split(r"[\s.,;:!?'\"()-]+", r.text.lower()) if w)
    top = [w for w, _ in counts.most_common(70) if any(c.isalpha() for c in w)]
    assert set(known["en"]["words"][:30]) <= set(top[:40])
    rows = {r._row.doc_id: r for r in quality_rules.rules(docs, list(known.values())).collect()}
    for d in docs.filter("lang = 'en'").collect():
        t, ref, r = d.text, known["en"], rows[d.doc_id]
        kinds = [sum(c.islower() for c in t), sum(c.isupper() for c in t)]
        letters = sum(c.isalpha() for c in t)
        rest = [sum(c.isspace() for c in t), sum(c.isdigit() for c in t), sum(c in ".,;:!?'\"()-" for c in t)]
        kinds += [letters - sum(kinds), *rest]
        kinds.append(len(t) - letters - sum(rest))
        want = math.sqrt(max(0, js([k / len(t) for k in kinds], ref["classes"]) - 6 / (8 * math.log(2) * len(t))))
        assert abs(r.class_distance - want) < 1e-6
        words = [w for w in re.split(r"[\s.,;:!?'\"()-]+", t.lower()) if w]
        if len(words) < quality_rules.MIN_WORDS:
            assert r.word_distance is None
            continue
        n = Counter(words)
        p, q = [n[w] / len(words) for w in ref["words"]], list(ref["shares"])
        want = math.sqrt(max(0, js([*p, 1 - sum(p)], [*q, 1 - sum(q)]) - len(ref["words"]) / (8 * math.log(2) * len(words))))
        assert abs(r.word_distance - want) < 1e-6
        assert r.kept == (not r.base_failed and r.class_distance <= quality_rules.MAX_CLASS and r.word_distance <= quality_rules.MAX_WORD)


def test_kernel():
    marks, texts = ["the cat sat", "der hund lief", "le chat noir"], ["the dog ran", "", "xyz", "The Cat sat", "äöü"]
    grams = lambda t: {b[k : k + n] for b in [t.lower().encode()] for n in (1, 2, 3) for k in range(len(b) - n + 1)}
    known = set().union(*map(grams, marks))
    weight = {1: 0.5, 2: 1.0, 3: 2.0}
    size = lambda xs: sum(weight[len(g)] for g in xs)
    want = [[size(grams(t) & grams(m)) / math.sqrt(max(size(grams(t) & known), 1e-18) * size(grams(m))) if grams(t) & known else 0.0 for m in marks] for t in texts]
    assert np.allclose(langid.Kernel(marks).rows(texts), want, atol=1e-5)


def test_letters_decide_und(spark):
    rows = [(1, "½ ² Ⅷ", "es"), (2, "12 :: !", "en"), (3, None, "en"), (4, "hello there", "en"), (5, "hola amigos", "es"), (8, "guten tag", "de")]
    got = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[1] == got[2] == got[3] == "und" and "und" not in (got[4], got[5], got[8])


def test_cumulative_link_fit():
    """The fit is at the least loss: no small step in any direction lowers it."""
    rnd = np.random.default_rng(3)
    grades = rnd.integers(0, 3, 300)
    rows = [np.unique(np.concatenate([rnd.integers(0, 5, 2) + 10 * g, rnd.integers(100, 110, 3)])) for g in grades]
    weight, cut = quality_classifier.fit(rows, grades, 3, steps=600)

    def loss(w, c):
        total = 0.0
        for r, g in zip(rows, grades, strict=True):
            s = sum(w[i] for i in r) / math.sqrt(math.log2(len(r) + 2))
            edge = [0.0, *(1 / (1 + math.exp(s - t)) for t in c), 1.0]
            total -= math.log(max(edge[g + 1] - edge[g], 1e-12))
        return total / len(rows) + 2e-4 / 2 * float((np.asarray(w, dtype=float) ** 2).sum())

    w, at = weight.astype(float), loss(weight, cut)
    for i in [0, 3, 11, 22, 104]:
        for step in (0.3, -0.3):
            moved = w.copy()
            moved[i] += step
            assert loss(moved, cut) > at - 1e-3
    assert cut[0] < cut[1] and all(loss(w, cut + d) > at - 1e-3 for d in (np.array([0.3, 0]), np.array([0, -0.3])))


def test_templates(spark):
    """Tokens and the hashes of windows against the same by hand."""
    texts = ["Ann paid 12.5 km for 3 apples in Rome", "12 km", "", "what is THE name of Bob"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [r.t for r in df.select(decontamination.tokens(F.col("text")).alias("t"), "doc_id").orderBy("doc_id").collect()]
    n, u, name, head = decontamination.NUMBER, decontamination.UNIT, decontamination.NAME, decontamination.HEAD
    assert got[0] == [head + "ann", "paid", n + "125", u + "km", "for", n + "3", "apples", "in", name + "rome"]
    assert got[1:3] == [[n + "12", u + "km"], []] and got[3][-1] == name + "bob"
