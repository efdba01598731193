"""Stage outputs in the shared folder, and the code that workers need."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import sentier.llm
from sentier.session import shared_path

# Kernels travel with the job: workers need not have this package installed.
cloudpickle.register_pickle_by_value(sentier.llm)


def stored(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the folder that ``spark.checkpoint.dir`` names
    and read it back: it is computed once, its lineage is cut, and a lost
    executor costs only the tasks it ran. ``few`` is for slim tables (ids and
    numbers): a sixteenth of the shuffle partitions write it, so that many small
    rounds don't leave many tiny files."""
    spark: SparkSession = df.sparkSession
    if few:
        df = df.coalesce(max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16))
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that no column of ``df`` has (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
