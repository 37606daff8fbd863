"""The pipeline's stages, each against a plain version of its decisions, and as a whole."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tidewatch.llm import packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "nrst"]
    shared = " ".join(rng.choice(words, 120))
    texts = [" ".join(rng.choice(words, 150)) for _ in range(30)]
    texts[1] = texts[0]
    texts[2] = texts[0] + " end"
    texts[5] += " " + shared
    texts[6] = shared + " " + texts[6]
    texts[7] += " write to someone@example.org"
    texts += [None, "too short", "again and again and so on it goes " * 40]
    rows = [(i, t, "en", "web", len(t) if t else 0) for i, t in enumerate(texts)]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(8, 30)] + [(31, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, texts, shared


def test_stages_follow_one_another(spark, corpus):
    d, texts, shared = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept.append({r.doc_id: r.text for r in docs.collect()})
    assert set(kept[0]) == set(range(30))
    assert set(kept[1]) == set(range(30)) - {1, 2}
    assert set(kept[2]) == set(kept[1]) and all(kept[2][i] == texts[i] for i in kept[2] if i not in (5, 6))
    assert shared not in kept[2][5] and shared not in kept[2][6] and len(kept[2][5]) < len(texts[5]) - 400
    assert kept[3][7].endswith("write to [email]")
    assert all(r.n_chars == len(r.text) for r in docs.filter("text is not null").collect())
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    tok = packing._tokenizer(packing.tokenizer_path())
    for i, t in kept[3].items():
        ids = [x for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start) for x in r.ids]
        assert ids == tok.encode(t, add_special_tokens=False).ids + [1]
    whole = corpus_pipeline.run(spark, d).select("doc_id", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, whole)) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)


def test_stages_take_empty_tables(spark, corpus):
    d = corpus[0]
    none = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, d).collect() == []


def test_stages_keep_rows_with_nulls_and_extra_columns(spark, corpus):
    d = corpus[0]
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("doc_id in (9, 10, 11)")
    docs = docs.withColumns({"doc_id": F.when(F.col("doc_id") > 9, F.col("doc_id")), "lang": F.lit(None).cast("string"), "row": F.lit(1), "key": F.lit(2), "root": F.lit(3)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and out.count() == 3, name


def test_entry_registers_the_subpackage():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names}
    assert set(__spark_entry__.oracle_sql()) <= set(names)
