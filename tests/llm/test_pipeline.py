"""The pipeline, stage by stage, against brute-force versions of what each stage may keep."""

import re

import corpus_pipeline as P
from pyspark.sql import functions as F

from cuegrain.llm import toxicity as Y
from cuegrain.llm.mixing import mixed_sizes

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in P.STAGES:
        before, docs = docs, P.cut(stage(spark, docs, SMALL), name)
        kept[name] = docs
        if name != "packing":
            assert docs.columns == columns
        if name == "toxicity":
            labels = spark.read.parquet(f"{SMALL}/labels.parquet")
            scores = Y.toxicity(before, labels).where("score < 0.5")
            assert {r.doc_id for r in docs.collect()} == {r.id for r in scores.collect()}
        elif name == "exact_dedup":
            first = {}
            for r in before.orderBy("doc_id").collect():
                first.setdefault(re.sub(r"[ \t\n\v\f\r]+", " ", r.text or ""), r.doc_id)
            assert sorted(r.doc_id for r in docs.collect()) == sorted(first.values())
        elif name == "near_dedup":
            sets = {}
            for r in before.collect():
                w = (r.text or "").encode().lower().split()
                sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
            links = {i: {j for j in sets if i != j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])} for i in sets}
            survivors, seen = set(), set()
            for i in sorted(sets):
                if i not in seen:
                    survivors.add(i)
                    todo = [i]
                    while todo:
                        if (x := todo.pop()) not in seen:
                            seen.add(x)
                            todo += links[x]
            assert {r.doc_id for r in docs.collect()} == survivors
        elif name == "mixing":
            taken = {r.id: r.taken for r in mixed_sizes(before).collect() if r.taken}
            got = docs.groupBy("doc_id").agg(F.sum(F.size(F.filter(F.split("text", "[ \t\n\x0b\f\r]+"), lambda w: w != ""))).alias("n"))
            assert {r.doc_id: r.n for r in got.collect()} == taken
        else:
            assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
            assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == {r.doc_id for r in before.select("doc_id").distinct().collect()}


def test_run_is_the_stages(spark):
    one = P.run(spark, SMALL).agg(F.count("*"), F.sum("length"), F.sum("ids_crc32")).first()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in P.STAGES:
        docs = P.cut(stage(spark, docs, SMALL), name)
    assert docs.agg(F.count("*"), F.sum("length"), F.sum("ids_crc32")).first() == one
