import json
import random

import pytest
from pyspark.sql import functions as F

from inkwell.config import Settings
from inkwell.operators import chunks
from inkwell.sources import benchmarks, uploads
from inkwell.streaming import ingest

RAW = "document_id string, page_number int, raw_text string"


def normal(spark, *texts):
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts, 1)], RAW)
    return [r.normalized_text for r in chunks.normalise_pages(df).orderBy("page_number").collect()]


def test_page_text(spark):
    assert normal(spark, "  Chapter 1 \n\n\nA   wrapped\tline  \n\n") == ["Chapter 1\n\nA wrapped line"]
    stacked = "Volume 3\nAcross The Moor\n\nRain fell on the empty station."
    assert normal(spark, stacked) == [stacked]
    assert normal(spark, None, "", "12") == ["", "", ""]


def test_boundaries(spark):
    bodies = [f"The {w} paragraph stays in place." for w in ("first", "second", "third")]
    assert normal(spark, *(f"Harbour Almanac\nSection Four\n\n{b}\n\n{i}" for i, b in enumerate(bodies, 1))) == bodies
    assert normal(spark, "Opening\n\nSome text here.\n\n1", "Closing\n\nOther text here.\n\n2") == ["Opening\n\nSome text here.", "Closing\n\nOther text here."]


def pages(spark, *texts):
    return spark.createDataFrame([("d", i, t) for i, t in enumerate(texts, 1)], "document_id string, page_number int, normalized_text string")


def test_chunks(spark):
    body = "alpha " * 99 + "end."
    rows = chunks.build_chunks(pages(spark, f"Volume 3\nAcross The Moor\n\n{body}", f"Next Part\n\n{body}\n\nLone Heading")).orderBy("chunk_index").collect()
    assert [(r.heading, r.provenance.heading_path, r.page_start, r.page_end, r.token_estimate) for r in rows] == [
        ("Across The Moor", ["Volume 3\nAcross The Moor"], 1, 1, 136),
        ("Next Part", ["Next Part"], 2, 2, 133),
    ]
    p = rows[1].provenance
    assert (p.paragraph_count, tuple(p.paragraph_range), tuple(p.char_range), p.source_page_numbers) == (2, (2, 3), (2, 0, 2, 11 + len(body)), [2])
    assert [(x.is_heading, x.page_paragraph_index) for x in p.paragraphs] == [(True, 0), (False, 1)]


def by_hand(paragraphs, target, least, overlap):
    """The texts of chunks, paragraph by paragraph. paragraphs: (text, words, is heading)."""
    out, held = [], []
    for text, n, head in paragraphs:
        bodies = [x for x in held if not x[2]]
        size = sum(x[1] for x in held)
        if head and bodies:
            out.append(held)
            held = []
        elif not head and bodies and size + n > target and size >= least:
            out.append(held)
            k = len(bodies) - 1
            while k > 0 and sum(x[1] for x in bodies[k:]) < overlap:
                k -= 1
            held = bodies[k:]
        held = [*held, (text, n, head)]
    if any(not x[2] for x in held):
        out.append(held)
    return ["\n\n".join(x[0] for x in c) for c in out]


@pytest.mark.parametrize("target, least, overlap", [(120, 80, 16), (280, 160, 16), (40, 10, 0), (60, 30, 200)])
def test_chunks_by_hand(spark, target, least, overlap):
    rnd = random.Random(target)
    made = []
    for i in range(60):
        head = rnd.random() < 0.15
        n = rnd.randint(1, 4) if head else rnd.randint(3, 70)
        made.append((" ".join([f"Title{i}"] * n) if head else " ".join([f"word{i}"] * (n - 1) + ["end."]), n, head))
    texts = ["\n\n".join(t for t, _, _ in made[k : k + 7]) for k in range(0, 60, 7)]
    got = chunks.build_chunks(pages(spark, *texts), chunks.Chunking(target, least, overlap)).orderBy("chunk_index").collect()
    assert [r.text for r in got] == by_hand(made, target, least, overlap)
    assert [r.chunk_index for r in got] == list(range(len(got)))


def test_suppress_and_pack(spark):
    rows = [("q", 1, ["a", "b"], 900), ("q", 2, ["b", "a"], 10), ("q", 3, ["c"], 900), ("q", 4, [], 100), ("r", 1, ["x"], 5000)]
    df = spark.createDataFrame(rows, "q string, rank int, terms array<string>, cost int")
    ranks = lambda d: sorted((r.q, r["rank"]) for r in d.collect())
    assert ranks(chunks.suppress_near_copies(df, "q", "rank", "terms")) == [("q", 1), ("q", 3), ("q", 4), ("r", 1)]
    assert ranks(chunks.pack(df, "q", "rank", "cost")) == [("q", 1), ("q", 2), ("q", 4), ("r", 1)]


def test_uploads(spark, tmp_path):
    for name, data in (("a b.pdf", b"%PDF-1"), ("copy.pdf", b"%PDF-1"), ("no.pdf", b"text"), ("x.txt", b"%PDF-2")):
        (tmp_path / name).write_bytes(data)
    got = uploads.register(uploads.read(spark, str(tmp_path))).cache()
    assert {r.path.rpartition("/")[2].replace("%20", " "): r.error for r in got.collect()} == {"a b.pdf": None, "copy.pdf": None, "no.pdf": "content", "x.txt": "extension"}
    bare = spark.createDataFrame([("empty.pdf", 0, b""), ("null.pdf", 0, None)], "path string, length long, content binary")
    assert [r.error for r in uploads.register(bare).collect()] == ["content"] * 2
    assert uploads.new_only(got, got.limit(0)).count() == 1
    assert uploads.new_only(got, got.filter("error is null")).count() == 0


def test_benchmarks(spark, tmp_path):
    q = {"question": "Why?", "expected_supported": True}
    made = {"name": "n", "documents": [{"filename": "f", "pages": ["one", "two"], "defaults": {"regression_tier": "exploratory"}, "questions": [q, q | {"regression_tier": "gating"}]}]}
    (tmp_path / "b.json").write_text(json.dumps(made, indent=1))
    df = benchmarks.read(spark, str(tmp_path / "b.json"))
    assert sorted(r.regression_tier for r in benchmarks.questions(df).collect()) == ["exploratory", "gating"]
    assert [(r.page_number, r.raw_text) for r in benchmarks.pages(df).collect()] == [(1, "one"), (2, "two")]
    made["defaults"] = {"regression_tier": "other"}
    made["documents"][0].pop("defaults")
    (tmp_path / "c.json").write_text(json.dumps(made))
    with pytest.raises(Exception, match="unknown tier"):
        benchmarks.questions(benchmarks.read(spark, str(tmp_path / "c.json"))).collect()


def test_benchmark_pages(spark, tmp_path):
    document = {"filename": "f", "questions": []}
    for name, extra in {"pdf": {"source_pdf": "x.pdf", "pages": ["ignored"]}, "none": {}}.items():
        (tmp_path / name).write_text(json.dumps({"name": "n", "documents": [document | extra]}))
    assert benchmarks.pages(benchmarks.read(spark, str(tmp_path / "pdf"))).count() == 0
    with pytest.raises(Exception, match="neither pages nor source_pdf"):
        benchmarks.pages(benchmarks.read(spark, str(tmp_path / "none"))).collect()


def test_settings():
    made = Settings.from_env(env={"INKWELL_TARGET_WORDS": "90", "INKWELL_ENABLE_LEXICAL": "no", "INKWELL_RERANK_WEIGHT": "0.5", "INKWELL_ANSWER_MODEL": "m"})
    assert (made.target_words, made.enable_lexical, made.rerank_weight, made.answer_model, made.min_words) == (90, False, 0.5, "m", 180)


def test_assemble(spark):
    rows = [("q", 1, 1, 1, 1, 1, ["a", "b"], 5), ("q", 2, 2, 2, 2, 2, ["a", "b"], 5), ("q", 3, 7, 1, 1, 3, ["a", "x"], 5), ("q", 4, 8, 3, 3, 4, ["c", "y"], 5), ("q", 5, 9, 4, 4, 5, ["d"], 90), ("q", 6, 20, 5, 5, 6, ["e"], 5)]
    schema = "q string, doc_id long, turn int, page_start int, page_end int, rank int, terms array<string>, cost int"
    df = spark.createDataFrame(rows, schema).withColumns({"raw": F.col("terms"), "q_terms": F.array(*map(F.lit, "abce"))})
    got = [r.doc_id for r in chunks.assemble(df, "q", budget=20).orderBy("place").collect()]
    # 2 is a near copy of 1 but its neighbour, with two question terms side by side; 3 says nothing new on the same page but stands beside 4.
    assert got == [1, 2, 4, 3]
    assert [r.doc_id for r in chunks.assemble(df.filter("doc_id = 5"), "q", budget=20).collect()] == [5]


def test_streaming_ingest(spark, tmp_path):
    source, table, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for text in ("gamma text.", "delta text."):
        spark.createDataFrame([("d", 1, f"A Heading\n\nThe {text}")], RAW).write.mode("append").parquet(source)
        ingest.ingest(spark.readStream.schema(RAW).parquet(source), table, check).awaitTermination()
    assert [r.text for r in ingest.latest(spark.read.parquet(table)).collect()] == ["A Heading\n\nThe delta text."]


def test_once(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES ('a', timestamp'2024-01-01 00:00:00'), ('a', timestamp'2024-01-01 00:01:00'), ('b', timestamp'2024-01-01 00:02:00') AS t(sha256, at)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = ingest.once(stream, "sha256", "at").writeStream.format("memory").queryName("once_rows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.sha256 for r in spark.table("once_rows").collect()) == ["a", "b"]


def test_block_is_what_stands_between_its_offsets(spark):
    text = "One  \n\n\t Two words\x0b \n\nthree  \u0085\n\n \n\nFour"
    rows = chunks.blocks(pages(spark, text), ["document_id"], "normalized_text").orderBy("block").collect()
    assert [r.text for r in rows] == [text[r.start : r.end] for r in rows] == ["One  ", "Two words", "three  \u0085", "Four"]


def test_heading_of_few_words(spark):
    texts = ["Of Ships", " Of Ships \n", "A " * 12, "A " * 13, "word " * 5000 + "End", "", " ", "The End.", "of ships", "12 Ships at sea", "A B", "\tA B"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", chunks.is_heading(F.col("t")).alias("h")).orderBy("i").collect()
    assert [r.h for r in got] == [True, True, True, False, False, False, False, False, False, False, True, True]
