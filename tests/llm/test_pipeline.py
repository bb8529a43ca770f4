import corpus_pipeline as P
from edittide.llm import near

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    import random

    rng = random.Random(0)
    clean = [(i, " ".join(f"c{rng.randrange(3000)}" for _ in range(60)), "en", f"s{i % 3}", 0) for i in range(60)]
    toxic = [(100 + i, " ".join([f"t{rng.randrange(3000)}" for _ in range(60)] + ["vile", "nasty"]), "en", "s0", 0) for i in range(40)]
    item = " ".join(f"b{i}" for i in range(12))
    extra = [(200, clean[3][1], "en", "s1", 0), (201, clean[4][1] + " more", "en", "s1", 0), (202, " ".join(f"d{i}" for i in range(40)) + " " + item, "en", "s2", 0), (203, item, "en", "s2", 0), (204, None, None, None, None), (205, "", "en", "s2", 0)]
    for name, rows, kind in (("documents", clean + toxic + extra, DOCS), ("labels", [(r[0], 1, int(r[0] >= 100)) for r in clean[:50] + toxic[:30]], "doc_id long, quality int, toxic int"), ("benchmark", [(1, item)], "item_id long, text string")):
        spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = []
    for i, (_, stage) in enumerate(P.STAGES[:-1]):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(str(tmp_path / f"out{i}"))
        docs = spark.read.parquet(str(tmp_path / f"out{i}"))
        left.append({r["doc_id"] for r in docs.collect()})
    assert left[0] == {r[0] for r in clean + extra}
    assert left[1] == left[0] - {200, 201}
    assert left[2] == left[1] - {203}
    assert "b5" not in next(r["text"] for r in docs.collect() if r["doc_id"] == 202)
    out = P.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == left[2]
    assert near.bands_for(0.8) > near.bands_for(0.85)


def test_clashing_columns(spark, tmp_path):
    text = "some words that are long enough to be a document of its own here"
    rows = [(1, text, "en", "a", 3, "s", "f", "n", "r", True), (2, text, "en", "a", 3, "s", "f", "n", "r", False), (None, "b " * 12, None, None, None, None, None, None, None, None), (3, "clean words only", "en", "b", 1, None, None, None, None, None)]
    kind = DOCS + ", scores string, Found string, n string, row string, is_toxic boolean"
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "b " * 10)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in kind.split(", ")]
    got = docs.collect()
    assert sorted((r["doc_id"], r["Found"], r["n"]) for r in got) == [(1, "f", "n"), (3, None, None)]
    assert P.run(spark, str(tmp_path)).count() == 2
    empty = spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0
