"""Plans and sizes of queries that pass over their table many times: what is read once, kept once, dealt to all cores."""

from pyspark.sql import functions as F

from cohort.operators import models, segment
from cohort.plans import score_queries, segment_queries, stream_queries

SF = "/root/testdata/sf0.001"


def test_clustering_and_scoring_read_the_stored_students(spark):
    df, scaled = segment_queries._scaled(spark, SF)
    for frame in (df, scaled, score_queries._linear(spark, SF)):
        assert not any("lineitem" in f or "orders" in f for f in frame.inputFiles())


def test_all_starts_share_the_persisted_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(float(i % 3 * 10 + i % 2), float(i % 5)) for i in range(60)], "a double, b double")
    levels, real = [], segment.KMeans.fit

    def fit(self, dataset, params=None):
        levels.append(dataset.storageLevel.useMemory)
        return real(self, dataset, params)

    monkeypatch.setattr(segment.KMeans, "fit", fit)
    _, _, out = segment.kmeans3(rows, ["a", "b"], starts=3)
    assert levels == [True] * 3
    assert out.count() == 60 and "features" not in out.columns


def test_forests_use_all_cores_and_small_ones_one_part(spark):
    rows = spark.range(5000).coalesce(1)
    assert models.forest_parts(rows, 5000).rdd.getNumPartitions() == 3
    assert models.forest_parts(rows, 1_000_000).rdd.getNumPartitions() == max(5, spark.sparkContext.defaultParallelism)
    assert models.forest_parts(rows, 100).rdd.getNumPartitions() == 1


def test_a_forests_fit_and_its_scoring_are_dealt_to_all_cores(spark, monkeypatch):
    parts, real = [], models.Pipeline.fit

    def fit(self, dataset, params=None):
        parts.append(dataset.rdd.getNumPartitions())
        return real(self, dataset, params)

    monkeypatch.setattr(models.Pipeline, "fit", fit)
    rows = spark.range(6000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("x"), (F.col("id") % 2).cast("double").alias(models.LABEL))
    model = models.fit(rows, "forest", ["x"], trees=2, forest_depth=2)
    assert parts == [3]
    assert model.transform(rows).count() == 6000


def test_the_request_streams_files_grow_in_number_not_in_size(spark, monkeypatch):
    monkeypatch.setattr(stream_queries, "FILE_ROWS", 100)
    df = stream_queries.students(spark, SF)
    _, rows = stream_queries._stream_source(df)
    n = df.count()
    assert rows.count() == n and len(rows.inputFiles()) == 4 * -(-n // 400)
    assert rows.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] < 200
