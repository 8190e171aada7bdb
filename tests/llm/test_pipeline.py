import os
import random

import corpus_pipeline

from chronoreel.llm import packing
from chronoreel.llm.common import dropped, fresh_path, stored, work_dir


def test_stages(spark, odd_docs, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = odd_docs
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == odd_docs.columns, name
        sizes.append(docs.count())
    assert sizes[0] == odd_docs.count() > sizes[1] == sizes[2]
    assert not docs.where("text LIKE '%0123456789abcdef%'").count()
    last = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(last.columns) == sorted(packing.pack(docs).columns) and last.count() == sizes[3]


def test_all_stages_decide(spark, tmp_path):
    """Labels that fit the network: junk goes, copies go, secrets go, the rest is mixed and packed; against plain rules."""
    rng = random.Random(3)
    words = "stone river light wind house road field winter morning letter table garden window river bread water".split()
    good = {i: " ".join(rng.choices(words, k=rng.randint(60, 90))) for i in range(160)}
    bad = {1000 + i: " ".join(w + "$$$" for w in rng.choices(words, k=60)) for i in range(80)}
    copies = {2000 + i: good[i] for i in range(20)}
    near = {3000 + i: good[40 + i] + " end" for i in range(20)}
    keyed = {4000: good[100] + ' token = "0123456789abcdef0123456789abcdef01234567" and more'}
    texts = good | bad | copies | near | keyed
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i in [*good, *copies]] + [(i, 0, 0) for i in bad]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, left = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, str(tmp_path)), "stage")
        left.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert not left[0].keys() & bad.keys() and left[0].keys() >= (good | copies).keys()
    assert left[1].keys() >= good.keys() - {100} and not left[1].keys() & (copies | near).keys()
    assert "0123456789abcdef" not in "".join(left[2].values()) and left[2].keys() == left[1].keys()
    assert left[3].keys() <= left[2].keys() and len(left[3]) > 100
    last = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert len(last) == docs.count() and set(last.doc_id) == left[3].keys()


def test_work_files_go(spark):
    kept, path = spark.range(3), fresh_path(spark, "x")
    assert f"chronoreel/{spark.sparkContext.applicationId}/x-" in path and work_dir(spark).endswith(spark.sparkContext.applicationId)
    held = stored(kept, "held")
    files = held.inputFiles()
    assert files and all(spark.sparkContext.applicationId in f for f in files)
    dropped(held)
    assert not os.path.exists(files[0].removeprefix("file://").removeprefix("file:"))


def test_empty(spark, no_docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
