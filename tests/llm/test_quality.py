import numpy as np

from conftest import SF_SMALL
from helpers import prose, table
from millrace.llm import quality

LABELS, PAGES = "doc_id long, quality int, toxic int", "page_id long, url string, html string"


def test_edges_and_no_labels(spark):
    labels, pages = spark.createDataFrame([], LABELS), spark.createDataFrame([], PAGES)
    got = quality.score(table(spark, clash=True), labels, pages).collect()
    assert len(got) == 14 and all(r.kept and r.score == 1.0 for r in got)
    assert quality.score(table(spark, []), labels, pages).count() == 0


def test_learns_and_keeps_clean(spark):
    rows, labels = [], []
    for i in range(200):
        bad = i % 4 == 0
        text = " ".join([prose(1, i)] * 80) if bad else prose(80, i)
        rows.append((i, text, "en", "a", len(text)))
        if i % 3:
            labels.append((i, int(not bad), 0))
    labels += [(1, None, 0), (None, 1, 0)]
    pages = [(1, "https://a.example.org/en/4?x=1", ""), (2, None, ""), (3, "nonsense", ""), (4, "http://b.net/7", "")]
    got = quality.score(table(spark, rows), spark.createDataFrame(labels, LABELS), spark.createDataFrame(pages, PAGES))
    wrong = [r for r in got.collect() if r.kept != (r.doc_id % 4 != 0)]
    assert not wrong


def test_held_out_accuracy(spark):
    """Labels the model never saw: the labels of every third id are withheld."""
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    labels = read("labels")
    got = quality.score(read("documents"), labels.filter("doc_id % 3 <> 0"), read("pages"))
    held = got.join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    right = sum(r.kept == (r.quality == 1) for r in held)
    assert right / len(held) > 0.93
    good = [r for r in held if r.quality == 1]
    assert sum(r.kept for r in good) / len(good) > 0.97


def test_without_keeps_other_rows(spark):
    docs = table(spark, clash=True)
    from pyspark.sql import functions as F
    gone = docs.filter("doc_id = 7").select("doc_id", F.xxhash64("text").alias("text_key")).limit(1)
    left = quality.without(docs, gone)
    assert left.columns == docs.columns
    assert left.count() in (12, 13)  # the twice repeated row, or the single one


def test_text_features_of_parts_equal_the_whole():
    texts = [None, "", "A b! B", prose(50, 1), "x" * 9]
    whole = quality.text_features(texts)
    for i, t in enumerate(texts):
        assert np.allclose(whole[i], quality.text_features([t])[0])


def test_sf_small_runs(spark):
    read = lambda t: spark.read.parquet(f"{SF_SMALL}/{t}.parquet")
    assert quality.score(read("documents"), read("labels"), read("pages")).count() == read("documents").count()


def test_long_names_that_end_alike_get_cells_of_their_own():
    import pandas as pd
    from millrace.llm import quality
    names = pd.Series([f"archive-{i:02d}/common-section-name" for i in range(60)] + [None])
    # nearly all cells are in use; by their ends alone the names would share one
    assert len(set(quality._cells(names, 0).tolist())) > quality.META_HASHED // 2


def test_features_of_many_texts_need_little_memory_at_once():
    import tracemalloc
    texts = [prose(1_500, i) for i in range(300)]  # about 3 MB
    quality.text_features(texts)
    tracemalloc.start()
    got = quality.text_features(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25 << 20  # 38 MB with slices of 1 MB
    # a text's features do not depend on the others of its slice
    assert all((quality.text_features([texts[i]])[0] == got[i]).all() for i in (0, 150, 299))
