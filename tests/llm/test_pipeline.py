import re

import pytest

from strandloom.llm.common import clear_work

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_every_stage_keeps_and_drops_what_it_should(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
        kept[name] = docs.toPandas()
        assert name == "packing" or docs.columns == columns
    clear_work()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").quality
    first, exact, near, clean, packed = (kept[n] for n, _ in corpus_pipeline.STAGES)
    assert set(labels[labels == 1].index) <= set(first.doc_id) and not set(labels[labels == 0].index) & set(first.doc_id)
    norm = first.text.map(lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t))
    assert set(exact.doc_id) == set(first.doc_id.groupby(norm).min())
    items = [re.findall(r"\w+", t.lower()) for t in spark.read.parquet(f"{SF}/benchmark.parquet").toPandas().text]
    leaks = lambda t: any(" ".join(x) in " ".join(re.findall(r"\w+", t.lower())) for x in items)
    assert set(clean.doc_id) == {d for d, t in zip(near.doc_id, near.text) if not leaks(t)}
    assert set(packed.doc_id) == set(clean.doc_id) and len(set(near.doc_id)) == len(near) < len(exact)
    whole = packed.groupby("doc_id").agg(n=("length", "sum"), want=("doc_tokens", "first"))
    assert (whole.n == whole.want).all()
    assert corpus_pipeline.run(spark, SF).count() == len(packed)
