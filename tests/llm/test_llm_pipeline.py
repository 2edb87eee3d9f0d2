"""The stages of the pipeline, each against brute force on what the one before kept."""

import re
from collections import Counter

import public_tokenizers
from cases import ROWS, SF, documents, empty, read, table

import corpus_pipeline
from corpusloom.llm import toxicity
from corpusloom.llm.queries import QUERIES


def test_registered():
    import __spark_entry__ as e

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert e.queries()["pipeline"] is corpus_pipeline.run
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_stages(spark, tmp_path):
    from test_llm_near_dedup import overlap, shingles
    from test_llm_packing import check

    docs = documents(spark)
    stages, seen = dict(corpus_pipeline.STAGES), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / name))
            out = spark.read.parquet(str(tmp_path / name))
        seen[name] = [r.asDict() for r in out.collect()]
        docs = out if name != "packing" else docs
    every = read(documents(spark))
    marks = spark.read.parquet(f"{SF}/labels.parquet")
    bad = {r["doc_id"] for r in read(toxicity.score(documents(spark), marks)) if r["predicted"]}
    ids = lambda name: Counter(r["doc_id"] for r in seen[name])
    assert ids("toxicity") == Counter(r["doc_id"] for r in every if r["doc_id"] not in bad)

    best = {}
    for r in seen["toxicity"]:
        t = r["text"] or ""
        key = re.sub("[ \t-\r]", "", t)
        best[key] = min(best.get(key, (1, 0)), (-len(t), r["doc_id"]))
    assert ids("exact_dedup") == Counter(i for _, i in best.values())

    kept = {r["doc_id"]: shingles(r["text"]) for r in seen["near_dedup"]}
    rest = [r for r in seen["exact_dedup"] if r["doc_id"] not in kept]
    assert len(kept) == len(seen["near_dedup"]) and rest
    order = sorted(kept)
    assert not [1 for k, i in enumerate(order) for j in order[:k] if overlap(kept[i], kept[j]) >= 0.8]
    other = {r["doc_id"]: shingles(r["text"]) for r in seen["exact_dedup"]}
    assert all(max(overlap(other[r["doc_id"]], other[i]) for i in other if i != r["doc_id"]) >= 0.8 for r in rest)

    assert set(ids("mixing")) == set(kept) and max(ids("mixing").values()) <= 2
    assert {tuple(sorted(r.items(), key=str)) for r in seen["mixing"]} == {tuple(sorted(r.items(), key=str)) for r in seen["near_dedup"]}
    check([(r["doc_id"], r["text"]) for r in seen["mixing"]], seen["packing"], 2048)
    assert stages.keys() == seen.keys()


def test_edges(spark):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), SF).count() == 0
        out = stage(spark, table(spark), SF)
        assert out.count() > 0 and (name == "packing" or out.columns == table(spark, ROWS).columns)
    assert public_tokenizers.path("byte_bpe_50k.json")


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
