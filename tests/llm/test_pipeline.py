"""The pipeline's stages, each on its predecessor's rows, and the registered queries."""

import re

import public_tokenizers
import pytest

import __spark_entry__
import corpus_pipeline
from quirework.llm import mixing, packing, simhash, toxicity
from tests.llm.test_operators import fingerprint, union_find

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert after.columns == columns, name
        if k < 3:
            assert before * 0.7 < after.count() < before, name
        if name == "SimHash near-dedup":
            told = simhash.simhash_components(after)
            assert told.where("doc_id <> component_id").count() == 0
        docs = after
    assert docs.agg({"length": "sum"}).first()[0] > 0


def test_stages_withstand_odd_rows(spark, docs, rows, empty, tmp_path):
    labels = spark.createDataFrame([(3, 1, 0), (6, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    model = toxicity.train(docs, labels)
    prints = [fingerprint(t) for _, t, _ in rows]
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    taken = [(r["taken"], r["size"]) for r in mixing.mix(docs).collect()]
    expected = {
        "toxicity": toxicity.score_toxicity(docs, model).where("score < 0.5").count(),
        "exact dedup": len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, _ in rows}),
        "SimHash near-dedup": len(set(union_find(len(rows), linked))),
        "mixing": sum(-(-n // size) for n, size in taken if size),
        "packing": packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")).count(),
    }
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == expected[name], name
        assert stage(spark, empty, str(tmp_path)).count() == 0, name


@pytest.mark.parametrize("n", range(1, 11))
def test_every_operator_has_a_query(n):
    assert sum(name.startswith(f"op{n}_") for name in __spark_entry__.queries()) == 1


def test_pipeline_is_registered():
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "SimHash near-dedup", "mixing", "packing"]
