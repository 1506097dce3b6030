from pyspark.sql import functions as F

from brightloom.functions.partitions import spread


def test_small_input_is_spread_and_large_is_left_alone(spark):
    cores = spark.sparkContext.defaultParallelism
    one = spark.range(0, 1000, 1, 1)
    assert spread(one).rdd.getNumPartitions() == cores and spread(one).count() == 1000
    many = spark.range(0, 1000, 1, cores * 2)
    assert spread(many) is many


def test_shuffled_input_is_not_run(spark):
    grouped = spark.range(100).groupBy((F.col("id") % 5).alias("k")).count()
    assert spread(grouped) is grouped
