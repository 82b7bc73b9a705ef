"""Features inside windows of 24 rows, so that frames of 20 rows are full: two suppliers' order lines against SQL."""

from pyspark.sql import functions as F

from fieldtrace.registry.dense import LENGTH, LINES, lines
from fieldtrace.registry.sequences import local_features, window_features_sql
from fieldtrace.registry.views import TRACK
from tests.oracle import compare, open_tables

SF = "/root/testdata/sf0.001"


def test_local_features_of_full_frames(spark):
    few = LINES.replace("FROM lineitem)", "FROM lineitem WHERE l_suppkey <= 2)")
    sql = f"SELECT * FROM ({window_features_sql(LENGTH).replace(TRACK, few)}) WHERE slot = {LENGTH - 1}"

    def run(spark, sf):
        return local_features(lines(spark, sf).where("entity_id <= 2"), LENGTH).where(F.col("slot") == LENGTH - 1)

    assert compare(spark, open_tables(SF), SF, run, sql) is None
