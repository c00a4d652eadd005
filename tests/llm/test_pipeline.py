"""The pipeline stage by stage against brute force on each stage's own input."""

import importlib
import random

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline
from graphlake.llm import decontaminate, quality_rules

from .test_operators import SCHEMA, components_brute, corpus, prose


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    rows = corpus(11, 150)
    items = [(i, prose(rng, 30)) for i in range(5)]
    rows += [(3000 + i, prose(rng, 70) + " " + items[i % 5][1].upper(), "en", "a", 0) for i in range(8)]
    rows += [(4000 + i, " | ".join(prose(rng, 120).split()), "en", "hot", 0) for i in range(30)]
    labels = [(r[0], int(not 4000 <= r[0] < 5000), 0) for r in rows if r[0] is not None][::2]
    pq.write_table(pa.table({"doc_id": [r[0] for r in labels], "quality": [r[1] for r in labels], "toxic": [r[2] for r in labels]}), tmp_path / "labels.parquet")
    pq.write_table(pa.table({"item_id": [i for i, _ in items], "text": [t for _, t in items]}), tmp_path / "benchmark.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = (before.collect(), docs.collect())
        if name != "mixing":
            assert docs.columns == before.columns
    before, after = seen["quality rules"]
    verdict = {r.doc_id: r.kept for r in quality_rules.query(spark.createDataFrame(rows, SCHEMA), spark.read.parquet(str(tmp_path / "labels.parquet"))).collect()}
    assert {r.doc_id for r in after} == {d for d, k in verdict.items() if k}
    assert not any(4000 <= (r.doc_id or 0) < 5000 for r in after) and sum(3000 <= (r.doc_id or 0) < 3008 for r in after) == 8
    before, after = seen["line dedup"]
    assert len(before) == len(after)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    held = {}
    for r in before:
        for x in r.text.split("\n"):
            held.setdefault(key(x), set()).add(r.doc_id)
    for r in before:
        want = "\n".join(x for x in r.text.split("\n") if not (len(key(x)) >= 20 and len(held[key(x)]) >= 3 and r.doc_id < max(held[key(x)])))
        assert want == next(a.text for a in after if a.doc_id == r.doc_id)
    before, after = seen["near duplicates"]
    parts = components_brute([(r.doc_id, r.text) for r in before], 5)
    assert sorted(r.doc_id for r in after) == sorted(d for d, (_, c) in parts.items() if d == c)
    before, after = seen["decontamination"]
    holds = {r.doc_id for r in before if any(decontaminate.normalised(t) in decontaminate.normalised(r.text) for _, t in items)}
    assert holds and {r.doc_id for r in after} == {r.doc_id for r in before} - holds
    before, after = seen["mixing"]
    assert {r.doc_id for r in after} <= {r.doc_id for r in before} and [r.mix_key for r in docs.orderBy("mix_key").collect()] == sorted(r.mix_key for r in after)
    total = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.copy) for r in total.collect()) == sorted((r.doc_id, r.copy) for r in after)


def test_stages_of_nothing(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.count("*")).first()[0] == 0


def test_queries_are_registered():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
