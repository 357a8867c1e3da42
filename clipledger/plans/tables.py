"""Access to the test tables."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Registry:
    """Named queries of one section, with the SQL each must agree with."""

    def __init__(self):
        self.queries, self.sql = {}, {}

    def add(self, name, sql=None):
        def wrap(fn):
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return wrap
