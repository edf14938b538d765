"""Decontamination against the same by hand on templated items."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest

from inkwell.llm import decontamination as own

PLAIN, UNITS = set(own.PLAIN.split()), set(own.UNITS.split())


def tokens(text):
    """(kind, word): number, unit, name, head or word. For texts of ASCII letters, digits, blanks and .,?"""
    out = []
    for m in re.finditer(r"[A-Za-z0-9]+", text):
        w, before = m[0], text[: m.start()]
        if w[0].isdigit():
            kind = "number"
        elif w.lower() in UNITS and re.search(r"[0-9] $", before):
            kind = "unit"
        elif w[0].isupper() and w.lower() not in PLAIN:
            kind = "name" if re.search(r"[A-Za-z0-9,;:] $", before) else "head"
        else:
            kind = "word"
        out.append((kind, w.lower()))
    return out


def forms(window):
    first = tuple(w if k in ("word", "head") else k for k, w in window)
    second = tuple("name" if k == "head" else w if k == "word" else k for k, w in window)
    third = tuple(w if k in ("word", "head", "name") else k for k, w in window)
    return first, second, third


def literals(form):
    return sum(t not in ("number", "unit", "name") for t in form)


def slots(toks):
    return [w for k, w in toks if k != "word"]


def class_of(toks):
    size = own.WINDOW if len(toks) >= own.WHOLE else len(toks)
    told = slots(toks)
    poor = [tuple(w for _, w in toks[a : a + size]) for a in range(len(toks) - size + 1) if max(map(literals, forms(toks[a : a + size]))) < own.LEAST]
    return tuple(w if k == "word" else k for k, w in toks), tuple(told.index(v) for v in told), tuple(poor)


def brute(docs, items):
    classes, out = defaultdict(list), set()
    for i, t in items:
        if toks := tokens(t or ""):
            classes[class_of(toks)].append((i, toks))
    for d, text in docs:
        there = tokens(text or "")
        for members in classes.values():
            n = len(members[0][1])
            size = own.WINDOW if n >= own.WHOLE else n
            known = []
            for a in range(n - size + 1):
                said = [[f for f in forms(m[a : a + size]) if literals(f) >= own.LEAST] for _, m in members]
                rich = bool(said[0])
                known.append((rich, {f for s in said for f in s} if rich else {tuple(w for _, w in m[a : a + size]) for _, m in members}))
            matched, held_by, exact = set(), [], set()
            for offset in range(-n, len(there)):
                places = set()
                for a, (_, hashes) in enumerate(known):
                    at = offset + a
                    if 0 <= at <= len(there) - size and (size > 1 or len(there) == 1):
                        w = there[at : at + size]
                        if hashes & ({f for f in forms(w)} if size >= own.LEAST else set()) or hashes & {tuple(x for _, x in w)}:
                            places.add(a)
                if not places:
                    continue
                told = slots(members[0][1])
                pairs, values, k = set(), [], -1
                for p, (kind, word) in enumerate(members[0][1]):
                    if kind == "word":
                        continue
                    k += 1
                    if any(a <= p < a + size for a in places):
                        values.append(there[offset + p][1])
                        if kind != "head" or told.count(word) > 1:
                            pairs.add((word, there[offset + p][1]))
                sides = min(len({x for x, _ in pairs}), len({y for _, y in pairs})) if pairs else 1
                held = 1.0 if not pairs else max(0.0, 2 - len(pairs) / sides)
                if held >= own.CONSISTENCY:
                    matched |= places
                    held_by.append(held)
                    if len(places) == len(known):
                        exact |= {i for i, m in members if slots(m) == values}
            rich = {a for a, (r, _) in enumerate(known) if r}
            share = max(len(matched) / len(known), len(matched & rich) / len(rich) if rich else 0)
            if matched and share >= own.COVERAGE:
                least = min(i for i, _ in members)
                out.add((d, min(exact) if exact else least, least, len(members), bool(exact), len(known), len(matched), round(share, 6), round(min(held_by), 6)))
    return out


NAMES = ["Alice", "Bob", "Clara", "Dan", "Eve", "France", "Spain"]
TEMPLATES = [
    "What is the capital of {a}?",
    "{a} bought {x} red apples at the market for {y} dollars, then {a} gave {b} about {x} of them",
    "Compute the distance when {a} walks {x} km and {b} walks {y} km towards the old bridge near {a} today",
    "What is {x} plus {y}?",
    "the slow train meets the quick train after {x} hours of travel",
]


def filled(rnd, template):
    a, b = rnd.sample(NAMES, 2)
    return template.format(a=a, b=b, x=rnd.randint(1, 30), y=rnd.randint(31, 60))


@pytest.fixture(scope="module")
def tables():
    rnd = random.Random(6)
    items = [(i, filled(rnd, TEMPLATES[i % 5])) for i in range(60)] + [(60, ""), (61, None), (62, "Zebra"), (7, filled(rnd, TEMPLATES[2])), (63, "plain words only here")]
    docs = []
    for i in range(90):
        t = filled(rnd, TEMPLATES[i % 5]) if i % 4 else items[rnd.randrange(60)][1]
        if i % 7 == 0:  # one value changed in one place
            words = t.split()
            k = rnd.randrange(len(words))
            t = " ".join([*words[:k], rnd.choice(["Xavier", "99", "word"]), *words[k + 1 :]])
        docs.append((i, " ".join(["filler"] * (i % 5)) + (". " if i % 2 else " so ") + t + " and more words"))
    for a, b, c in (("Xavier", "Xavier", "Xavier"), ("Dan", "Dan", "Eve")):  # many values for one
        docs.append((100, f"{a} bought 7 red apples at the market for 7 dollars, then {b} gave {c} about 7 of them"))
    return docs + [(200, None), (201, ""), (202, "zebra"), (203, "a zebra"), (5, docs[5][1]), (204, "x " * 3000 + items[1][1])], items


def test_as_by_hand(spark, tables):
    docs, items = tables
    got = own.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    rows = {(r.doc_id, r.item_id, r.class_id, r.n_items, r.exact, r.n_windows, r.n_matched, round(r.coverage, 6), round(r.consistency, 6)) for r in got.collect()}
    want = brute(docs, items)
    assert rows == want and len(want) > 60 and sum(r[4] for r in want) > 20


def test_templated_items_are_a_class(spark):
    """200 items of one template: a row for each document, not for each pair."""
    bench = spark.createDataFrame([(i, f"What is the capital of {chr(65 + i // 26)}{chr(97 + i % 26)}land?") for i in range(200)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"Here. What is the capital of {'Balland' if i % 2 else 'Bbland'}?") for i in range(10)], "doc_id long, text string")
    got = own.contaminated(docs, bench).collect()
    assert sorted((r.doc_id, r.class_id, r.n_items, r.exact, r.item_id) for r in got) == [(i, 0, 200, i % 2 == 0, 0 if i % 2 else 27) for i in range(10)]
    assert {(r.item_id, r.class_id) for r in own.members(bench).collect()} == {(i, 0) for i in range(200)}


def test_slots_are_one_to_one(spark):
    item = "Alice met Robert and Clara near the old harbour before Alice left the town with Robert again"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    new = {"Alice": "Xena", "Robert": "Yann", "Clara": "Zoe"}
    swap = lambda m: re.sub("|".join(m), lambda x: m[x[0]], item)
    docs = [(1, swap(new)), (2, swap(dict.fromkeys(new, "Xavier"))), (3, swap({**new, "Clara": "Yann"})), (4, swap(new).replace("Xena left", "Wanda left")), (5, item)]
    got = own.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.exact) for r in got} == {(1, False), (5, True)}
