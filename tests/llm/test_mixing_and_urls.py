from pyspark.sql import functions as F

from riftspark.llm import mixing, url_filter


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def table(df):
    sizes = df.select("doc_id", "source", mixing.word_count("text").alias("size"), mixing.key_hash("doc_id").alias("hash"))
    return mixing.with_source(sizes, mixing.thresholds(sizes)).withColumn("taken", F.col("size") * mixing.passes_of())


def test_targets_share_all_and_stop_at_the_cap(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 100), ("c", 800), (None, 0), ("d", 1)], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    total = 1001
    assert abs(sum(got.values()) - total) < 1e-6
    assert got["d"] == 3.0 and got[None] == 0.0 and all(got[s] <= 3 * n + 1e-9 for s, n in (("a", 100), ("b", 100), ("c", 800)))
    # weights a 1, b 2, c 3, d 1: b and d are capped, a and c share what is left by 1 and 3
    assert got["b"] == 300.0 and abs(got["a"] - 698 / 4) < 1e-6 and abs(got["c"] - 3 * 698 / 4) < 1e-6


def test_taken_words_come_near_the_targets(spark):
    rows = [(k, "w " * (1 + k % 17), f"s{k % 3 if k % 2 else 0}") for k in range(3000)]
    got = table(documents(spark, rows)).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect()
    assert all(abs(r.t - r.target) <= 17 and r.over <= 0 for r in got)


def test_nulls_repeated_rows_and_empty_tables(spark):
    df = documents(spark, [(1, "a b", None), (1, "a b", None), (None, None, "x"), (2, "", "x"), (3, "a", "y")])
    got = table(df).collect()
    assert len(got) == 5 and all(0 <= r.taken <= 3 * r.size for r in got)
    assert mixing.mix(df).columns == df.columns
    assert table(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0


def test_mix_repeats_rows(spark):
    df = documents(spark, [(k, "w w w", "big" if k else "small") for k in range(200)])
    assert abs(mixing.mix(df).count() - 200) <= 3
    assert mixing.mix(df).where("source = 'small'").count() == 3


URLS = [
    (1, "http://a.COM/x?y#z"), (2, "https://www.example.com/en/1"), (3, "https://blog.example.com/en/1"), (4, "http://x.net/es/1"), (5, "http://net/fr/"), (6, "http://x.org/a"),
    (7, "http://www.x.org/a/?utm_source=f"), (8, None), (9, "no url"), (10, "ftp://h?q"), (11, "http://b.com"), (12, "http://x.org:80/a#f"), (13, "http://x.org/b"),
]


def test_rules_and_list(spark):
    pages = spark.createDataFrame(URLS, "page_id long, url string").withColumn("HOST", F.lit("clash"))
    listed = spark.createDataFrame([("x.org/a",), ("x.org/a",), (None,), ("z.org/q",)], "canonical string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, listed).collect()}
    assert got[1] == ("a.com", "/x", "com/", "allow")
    assert got[2][2:] == ("www.example.com/en/", "allow") and got[3][2:] == ("example.com/en/", "block")
    assert got[4][2:] == ("net/es/", "block") and got[5] == ("net", "/fr/", "net/fr/", "block")
    assert [got[k][2:] for k in (6, 7, 12)] == [(None, "block")] * 3
    assert got[13][2:] == (None, "allow") and got[8] == ("", "", None, "allow") == got[9]
    assert got[10][:2] == ("h", "") and got[11] == ("b.com", "", None, "allow")
    assert url_filter.judge(pages, listed.limit(0)).where("verdict = 'block'").count() == 3
    assert url_filter.judge(pages.limit(0), listed).count() == 0


def test_bloom_filter_loses_nothing_and_passes_little(spark):
    urls = spark.range(4000).select(F.concat(F.lit("h.org/"), F.col("id").cast("string")).alias("canonical"))
    kept = url_filter.common.keep(urls.where("canonical like '%7'"), "t")
    blocks, n = url_filter.bloom(kept)
    probed = url_filter.possible(urls, blocks, n)
    assert probed.where("canonical like '%7' and not possible").count() == 0
    assert probed.where("canonical not like '%7' and possible").count() < 72


def test_many_sources_have_the_targets_of_few(spark):
    sizes = spark.createDataFrame([(f"s{k % 97}", (k * k) % 50 if k % 97 else 900) for k in range(400)] + [(None, 3), ("é", 0), ("Z", 7)], "source string, size long").repartition(5)
    few, many = (sorted(((r.source or "~", r.source_size, r.target) for r in mixing.targets(sizes, few=n).collect())) for n in (1000, 3))
    assert few == many and len(few) == 100
    assert mixing.targets(sizes.limit(0), few=-1).count() == 0


def test_clashing_columns_and_long_texts(spark):
    df = documents(spark, [(1, "w " * 400_000, "a"), (2, "w", "a"), (3, None, "b")])
    df = df.withColumns({"hash": F.lit(1), "size": F.lit("x"), "rest": F.lit(2), "target": F.lit(0), "passes": F.lit(9), "bucket": F.lit(4)})
    got = mixing.mix(df)
    assert got.columns == df.columns and {r.size for r in got.collect()} <= {"x"}
    pages = spark.createDataFrame([(1, "http://a.org/" + "x" * 300_000, 5, "keep"), (2, "http://b.org/?utm_a=1", 6, None), (3, "http://b.org", 7, "r")], "page_id long, url string, block int, rule string")
    judged = url_filter.judge(pages, spark.createDataFrame([("b.org",)], "canonical string")).withColumnRenamed("block", "kept")
    assert sorted((r.page_id, r.kept, r.rule, r.verdict) for r in judged.collect()) == [(1, 5, None, "allow"), (2, 6, None, "block"), (3, 7, None, "block")]
