"""The pipeline's stages on a small folder, each against its operator."""

import random

import corpus_pipeline
import __spark_entry__
from tests.llm.test_operators import toxic_corpus


def test_pipeline(spark, tmp_path):
    out, marks = toxic_corpus()
    rows = [(i, t, "en", "s", len(t)) for i, t in out] + [(2000 + i, out[i][1].upper(), "en", "s", 1) for i in range(1, 40) if i % 6]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(d + "/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in marks], "doc_id long, quality int, toxic int").write.parquet(d + "/labels.parquet")
    docs = spark.read.parquet(d + "/documents.parquet")
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, d)
        if k < 4:
            assert made.columns == docs.columns
        made.write.parquet(f"{d}/{k}")
        docs = spark.read.parquet(f"{d}/{k}")
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4]
    assert docs.agg({"length": "sum"}).first()[0] > 0
    assert corpus_pipeline.run(spark, d).count() == counts[5]


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= names


def test_pipeline_cuts_passages_of_51_words(spark):
    rng = random.Random(4)
    words = lambda n, size=6: " ".join("".join(rng.choice("abcdefghïj") for _ in range(size)) for _ in range(n))
    passage, short, long = words(51, 4), words(50, 4), words(8, 60)
    assert len(passage.encode()) < 400 < len(long.encode())
    own = [words(40) for _ in range(9)]
    texts = [f"{own[i]} {x}{gap}{own[i + 1]}" for i, x, gap in ((0, passage, " "), (2, passage.replace(" ", "\n"), "\n"), (4, short, " "), (6, short, " "))] + [f"{own[8]} {long} {i}" for i in range(2)]
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.cut_repeats(spark, d, "").collect()}
    assert got[0].text == f"{own[0]}  {own[1]}" and got[1].text == f"{own[2]} \n{own[3]}"
    assert [got[i].text for i in (2, 3)] == texts[2:4]
    assert all(got[i].text.strip() == str(i - 4) for i in (4, 5))
    assert all(r.n_chars == len(r.text) for r in got.values())
