"""The pipeline's stages on the smallest tables."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[1:4]:
        before = docs.count()
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns, name
        assert docs.count() == before if name == "personal_data" else docs.count() <= before
    assert docs.select("doc_id").distinct().count() == docs.count()
    assert not docs.where("text rlike '[a-z]+\\\\.[0-9]+@mail'").count()


def test_registered():
    names = queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert {n for n in oracle_sql() if n.startswith("op")} == {
        "op1_spaced_seeds", "op3_line_frequency", "op9_repeated_windows", "op10_archive",
        "op13_gram_blocks"}


def test_run(spark, tmp_path):
    """The whole pipeline on planted rows: what each stage must drop or keep, and every id of what is left packed."""
    draw = np.random.default_rng(1)
    vocab = ["".join(chr(97 + c) for c in draw.integers(0, 26, 6)) for _ in range(400)]

    def prose(n):
        return " ".join(draw.choice(vocab, n))

    item = prose(40)
    base = prose(90)
    near = base.split()
    near[30] = "changed"
    toxic = {i: f"{prose(40)} you grumbolt fool grumbolt {prose(40)}" for i in range(100, 160)}
    clean = {i: prose(80) for i in range(200, 280)}
    rows = {**toxic, **clean, 1: base, 2: " ".join(near), 3: base, 4: f"{prose(20)} {item} {prose(20)}", 5: None, 6: "",
            7: f"{prose(30)} write to ann.lee@mail.example or so {prose(30)}"}
    docs = [(i, t, "en", "s", len(t or ""), 0.5) for i, t in rows.items()] + [(None, prose(50), "en", "s", 1, 0.5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, toxicity_score double"
                          ).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in [*toxic, *clean]], "doc_id long, quality int, toxic int"
                          ).write.parquet(f"{tmp_path}/labels.parquet")
    kept = {}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert not set(kept["toxicity"]) & set(toxic)
    assert set(kept["toxicity"]) == set(rows) - set(toxic) | {None}
    assert set(kept["toxicity"]) - set(kept["near_duplicates"]) == {2, 3}
    assert set(kept["near_duplicates"]) - set(kept["decontamination"]) == {4}
    left = kept["personal_data"]
    assert {i for i in left if left[i] != kept["decontamination"][i]} == {7}
    assert "ann.lee@mail.example" not in left[7] and "[EMAIL]" in left[7]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p["doc_id"] for p in pieces} == set(left)
    for i in left:
        mine = sorted((p["start"], p["length"], p["doc_tokens"]) for p in pieces if p["doc_id"] == i)
        assert sum(length for _, length, _ in mine) == mine[0][2]
        assert [start for start, _, _ in mine] == [sum(n for _, n, _ in mine[:k]) for k in range(len(mine))]
