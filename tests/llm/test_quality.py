from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from costurero.llm import quality

SF = "/root/testdata/sf0.01"


def pairs(documents, text):
    rows = quality.with_words(documents([(1, text)]))
    return [r.pair for r in quality.grams(rows, quality.Settings()).collect() if r.pair is not None]


def test_pairs_see_the_whole_shape_of_words(documents):
    plain = pairs(documents, "win some here")
    assert plain == pairs(documents, "lose more words")
    for junk in ("###win some here", "win a1b2c here", "win foo|bar here", "w--in some here"):
        got = pairs(documents, junk)
        assert len(got) == len(plain) and got != plain


def test_every_labelled_document_counts(spark):
    n = 21_000
    docs = spark.range(n + 1000).selectExpr("id AS doc_id", "'alpha beta' AS text")
    labels = spark.range(n).selectExpr("id AS doc_id", "1 AS quality")
    s = quality.Settings()
    got = set(quality.learned(docs, labels, s))
    log = lambda a, b, k: round(math.log((a + 1) / (k * n + s.buckets) / ((b + 1) / (k * (n + 1000) + s.buckets))) * 1e6)
    assert got == {log(n, n + 1000, 2), log(0, 0, 2), log(n, n + 1000, 1), log(0, 0, 1)}
    scores = spark.range(n).selectExpr("id AS doc_id", "id AS points")
    assert quality.threshold(scores, labels, s) == math.floor(s.lost * n)


@pytest.mark.parametrize("bits", [1 << 15, 1 << 25])
def test_bitmap_lets_every_id_through_and_few_others(spark, bits):
    ids = spark.range(0, 3000, 3).selectExpr("id * 1000003 AS doc_id")
    rows = spark.range(3000).selectExpr("id", "id * 1000003 AS doc_id").union(spark.sql("SELECT 0L, CAST(NULL AS BIGINT)"))
    passed = [r.id for r in quality.likely_among(rows, ids, bits).collect()]
    assert {i for i in passed if i % 3 == 0} >= set(range(0, 3000, 3))
    assert len(passed) <= 1000 + (200 if bits < 1 << 20 else 3)
    assert quality.likely_among(rows, ids.where("false"), bits).count() == 0


def test_result_does_not_depend_on_partitions(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    results = set()
    for n in (1, 7, 211):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.add(str(sorted(map(str, quality.report(docs.repartition(n), labels.repartition(n)).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(results) == 1


def test_report_is_native_and_moves_no_unlabelled_text(spark, monkeypatch):
    """Every plan of the report, also those that run while it learns."""
    plans = []
    for name in ("counts", "scored", "threshold"):
        inner = getattr(quality, name)
        monkeypatch.setattr(quality, name, lambda df, *a, inner=inner: plans.append(df) or inner(df, *a))
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    plans.append(quality.report(docs, labels))
    texts = [df._jdf.queryExecution().executedPlan().toString() for df in plans]
    assert len(texts) == 5 and not any(w in t for t in texts for w in ("Python", "Arrow", "Pandas", "ExistingRDD"))
    joined = [t for t in texts if "SortMergeJoin" in t]
    assert len(joined) == 1 and "getbit" in joined[0]


def test_held_out_labels(spark):
    """Learned from two thirds of the labelled documents, it keeps the good ones of the rest and drops most bad ones."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    kept = quality.report(docs, labels.where("crc32(CAST(doc_id AS STRING)) % 3 <> 1")).select("doc_id", "kept")
    held = labels.where("crc32(CAST(doc_id AS STRING)) % 3 = 1").join(kept, "doc_id")
    shares = {r.quality: r.share for r in held.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert shares[1] > 0.97 and shares[0] < 0.2
