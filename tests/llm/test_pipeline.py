"""The pipeline on a small corpus: what each stage is to take out goes, everything else stays."""

from __future__ import annotations

import random

import corpus_pipeline as pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(4)
    say = lambda n: " ".join("".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n))
    texts = {i: say(80) for i in range(30)}
    texts[30] = texts[3]
    texts[31] = " ".join("xx" if k == 7 else w for k, w in enumerate(texts[4].split()))
    texts |= {32: None, 33: "12 !! 34", 34: ""}
    item = say(40) + ". " + say(6) + "."
    texts[35] = f"{say(60)} {item} {say(30)}"
    texts[36] = say(50) + " write to a.b@example.com or call +1 (988) 555-2485"
    long = say(30_000)
    rows = [(i, t, "en", "src", len(t or ""), i) for i, t in texts.items()] + [(None, say(20), None, None, None, -1)]
    rows += [(7, say(90), "en", "src", 0, -2), (8, texts[8], "en", "src", len(texts[8]), 8), (40, long, "en", "src", len(long), 40)]
    columns = ["doc_id", "text", "lang", "source", "n_chars", "version"]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, version int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs = pipeline.read(spark, str(tmp_path), "documents")
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k + 1 < len(pipeline.STAGES):
            assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/stage-{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage-{k}")
    kept = {r.doc_id for r in docs.collect()}
    # Two documents have the id 7, and both stay; the row that stands twice (8) is one.
    assert kept == {*range(30), 36, 40, None} and docs.count() == 34
    assert docs.where("rate is null or domain is null").count() == 0
    clean = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/stage-3").collect()}
    assert clean[36].text.endswith("write to [email] or call [phone]") and clean[36].n_chars == len(clean[36].text)
    assert all(clean[i].text == texts[i] and clean[i].version == i for i in range(30) if i != 7) and clean[40].text == long
    assert {r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()} == kept


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_decontamination_is_by_row(spark, tmp_path):
    rng = random.Random(5)
    say = lambda n: " ".join("".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(n))
    item, clean = say(60) + ".", say(80)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"{say(20)} {item} {say(20)}"), (7, f"{say(20)} {item}"), (7, clean), (None, say(70)), (7, clean), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    left = pipeline.decontamination(spark, docs, str(tmp_path))
    assert left.columns == docs.columns and sorted((r.doc_id or -1, r.text or "") for r in left.collect()) == sorted((i or -1, t or "") for i, t in rows[2:])


def test_near_dedup_keeps_the_least_id_where_ids_repeat(spark, tmp_path):
    rng = random.Random(6)
    say = lambda n: [("".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3))) for _ in range(n)]
    rows, want = [], set()
    for k in range(60):
        words = say(80)
        one, two = " ".join(words), " ".join(["zz", *words[1:]])
        low, high = 10 * k, 10 * k + 1
        rows += [(low, one), (high, two), (high if k % 2 else low, " ".join(say(70)))]  # one side's id stands twice
        want |= {(low, one), (rows[-1][0], rows[-1][1])}
    gone, kept = " ".join(say(80)), " ".join(say(80))
    rows += [(None, gone), (5000, gone + " zz"), (None, kept), (None, kept)]
    want |= {(5000, gone + " zz"), (None, kept)}
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(3)
    left = pipeline.near_dedup(spark, docs, str(tmp_path))
    assert left.columns == docs.columns and sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(want, key=str)


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = pipeline.read(spark, str(tmp_path), "documents")
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns and stage(spark, docs, str(tmp_path)).count() == 0
    assert pipeline.run(spark, str(tmp_path)).count() == 0
