import random

from pyspark.sql import functions as F

import corpus_pipeline


def test_stages_take_effect(spark, tmp_path):
    rnd = random.Random(11)
    vocab = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 6))) for _ in range(800)]
    make = lambda n: " ".join(rnd.choices(vocab, k=n))
    base, passage, item = make(300), make(70), make(30)
    near = base.split()
    near[5] = "changed"
    rows = [(i, make(80)) for i in range(40)]
    rows += [(100, base), (101, " ".join(near)), (102, f"{make(100)} {passage}"), (103, f"{passage} {make(100)}"), (104, f"{make(60)} {item}"), (105, "12 34"), (106, None)]
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).persist()
        seen[name] = docs
    ids = lambda name: {r["doc_id"] for r in seen[name].select("doc_id").collect()}
    assert ids("language") == {i for i, _ in rows} - {105, 106}
    assert ids("language") - ids("near_duplicates") == {101}
    texts = {r["doc_id"]: r["text"] for r in seen["repeated_passages"].collect()}
    assert passage in texts[102] and passage not in texts[103] and texts[3] == dict(rows)[3]
    assert ids("repeated_passages") - ids("benchmark_leaks") == {104}
    assert seen["benchmark_leaks"].columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert seen["benchmark_leaks"].filter(F.col("n_chars") != F.length("text")).isEmpty()
    packed = seen["packing"].groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n"))
    assert packed.filter("n != doc_tokens").isEmpty() and ids("packing") == ids("benchmark_leaks")
