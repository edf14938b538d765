"""The whole pipeline on a small table with odd rows, against each stage by hand."""

from __future__ import annotations

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, _no long"
ITEM = "A train leaves the harbour at 10 km and meets the ferry with 10 apples, then the ferry pays 25 dollars for 10 tickets again today."


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(8)
    common = "the of and to in is that it was for on with as at by this are from or but".split()
    words = ["".join(rnd.choice("aeioudlnrst") for _ in range(rnd.randint(3, 8))) for _ in range(3000)]
    line = lambda n: " ".join(rnd.choice(common) if rnd.random() < 0.4 else rnd.choice(words) for _ in range(n))
    prose = lambda n: "\n".join(line(12).capitalize() + "." for _ in range(n // 12))
    good = [prose(120) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(good)]
    rows += [(100, good[3]), (101, good[3]), (3, good[3])]  # copies, and a repeated row
    rows += [(200, None), (201, ""), (202, "too short"), (203, "spam " * 400), (None, good[7])]
    rows += [(300, good[9] + "\n" + ITEM), (301, good[10] + " write to jane.roe@mail.example.org or 10.1.2.3 now")]
    rows += [(400, prose(400_000))]  # 2.5 MB
    made = [(i, t, "en", "s", len(t or ""), f"k{i}", 7) for i, t in rows]
    return made


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(corpus, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages(spark, folder, corpus):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, folder)
        assert docs.columns == before.columns
        seen[name] = docs.collect()
        docs = spark.createDataFrame(seen[name], docs.schema)
        assert all(r._key == f"k{r.doc_id}" and r._no == 7 for r in seen[name])
    ids = {k: {r.doc_id for r in v} for k, v in seen.items()}
    assert ids["quality_rules"] == {r[0] for r in corpus} - {200, 201, 202, 203}
    # Copies of one text: the least id stays, null ids last, a repeated row once.
    assert ids["near_dedup"] == ids["quality_rules"] - {100, 101, None}
    assert sorted(r.doc_id for r in seen["near_dedup"]) == sorted(ids["near_dedup"])
    assert ids["decontamination"] == ids["near_dedup"] - {300}
    text = {r.doc_id: r.text for r in seen["pii"]}
    assert "[EMAIL]" in text[301] and "[IP]" in text[301] and "jane.roe" not in text[301]
    before = {r.doc_id: r.text for r in seen["decontamination"]}
    assert all(text[i] == before[i] for i in text if i != 301)
    assert all(r.n_chars == len(r.text) for r in seen["pii"])


def test_run(spark, folder):
    from tokenizers import Tokenizer

    from inkwell.llm import bpe

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
    model = Tokenizer.from_file(bpe.default_vocabulary())
    want = sorted((r.doc_id, model.encode(r.text, add_special_tokens=False).ids) for r in docs.collect())
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, list(r[-1])) for r in got) == want


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
