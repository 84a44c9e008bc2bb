import random

import corpus_pipeline as cp
import numpy as np
from lattica.llm import op1_quality, op2_simhash
from test_simhash import edited, exact_groups, family


def test_stages_keep_their_contract(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in cp.STAGES[:-1]:
        seen.append(cp.materialize(stage(spark, seen[-1], sf_dir), name))
        assert seen[-1].columns == columns
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert ids[1] == {r.doc_id for r in op1_quality.judge(docs).where("q_rejected_by IS NULL").collect()}
    assert ids[2] < ids[1]
    found = op2_simhash.similar_groups(seen[2]).collect()
    assert ids[3] == {r.component_id for r in found} and seen[3].count() == len(ids[3])
    assert ids[4] <= ids[3]
    packed = cp.packing(spark, seen[4], sf_dir)
    assert packed.where("piece = 0").count() == seen[4].count()


def test_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_near_duplicates_keep_one_of_each_exact_group(spark):
    rng = random.Random(23)
    texts = [" ".join(w) for w in family(rng, 300, [0.005, 0.02, 0.03])]
    for _ in range(60):  # pairs of 0.6 to 0.8 besides
        words = family(rng, 1, [0])[0]
        texts += [" ".join(words), " ".join(edited(rng, words, 0.03))]
    want, alike = exact_groups(texts)
    assert (np.triu((alike >= 0.6) & (alike < 0.8), 1)).sum() > 100
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in cp.near_duplicates(spark, docs, "").select("doc_id").collect()} == set(want.values())
