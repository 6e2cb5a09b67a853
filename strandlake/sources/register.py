"""Makes the Python sources known to a session."""

import sys

from pyspark import cloudpickle
from pyspark.sql import SparkSession

_done: set[str] = set()


def register(spark: SparkSession) -> None:
    """Once a session; the classes travel by value, as workers need not have this package on their path."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # readers here take id filters
    if spark.sparkContext.applicationId + str(id(spark)) in _done:
        return
    from strandlake import schema
    from strandlake.sources import binary, fastq, paths

    for module in (schema, paths, fastq, binary, sys.modules["strandlake.sources"], sys.modules["strandlake"]):
        cloudpickle.register_pickle_by_value(module)
    for source in (fastq.FastqSource, binary.SmrtSource, binary.TracSource):
        spark.dataSource.register(source)
    _done.add(spark.sparkContext.applicationId + str(id(spark)))
