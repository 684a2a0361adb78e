import pytest

import corpus_pipeline
from turfline.llm import circulant_minhash, template_leaks
from turfline.session import settle

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, FOLDER), name)
        out[name] = docs
    return out


def test_stages_keep_columns_and_take_effect(outputs):
    names = list(outputs)
    ids = {n: [r.doc_id for r in f.select("doc_id").collect()] for n, f in outputs.items()}
    for n in names[:-1]:
        assert outputs[n].columns == outputs["documents"].columns
    for before, after in zip(names, names[1:], strict=False):
        assert set(ids[after]) <= set(ids[before])
    assert len(ids["near_duplicates"]) == len(set(ids["near_duplicates"])) < len(ids["quality"]) < len(ids["documents"])
    assert len(ids["mixing"]) > len(set(ids["mixing"])) and sorted(ids["sharding"]) == sorted(ids["mixing"])


def test_nothing_is_left_to_do(spark, outputs):
    left = outputs["decontamination"]
    assert circulant_minhash.near_duplicates(left).where("not kept").count() == 0
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    assert template_leaks.leaks(left, items).count() == 0
    shards = outputs["sharding"].groupBy("doc_id").agg({"shard": "min", "grown_shard": "max"}).collect()
    assert all(r["min(shard)"] in range(40) and r["max(grown_shard)"] in (r["min(shard)"], 40) for r in shards)
