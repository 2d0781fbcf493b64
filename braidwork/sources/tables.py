"""Tables of a data folder, and schemas of conversation data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

COORDINATE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x", "y", "z", "t")] + [T.StructField("n_parts", T.IntegerType())])
MESSAGE = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("role", T.StringType()),
        T.StructField("parts", T.ArrayType(T.StringType())),
        T.StructField("create_time", T.DoubleType()),
        T.StructField("weight", T.IntegerType()),
    ]
)
#: A tree as it is stored in JSON: a map from node ids to nodes.
TREE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("create_time", T.DoubleType()),
        T.StructField("update_time", T.DoubleType()),
        T.StructField("current_node", T.StringType()),
        T.StructField(
            "mapping",
            T.MapType(
                T.StringType(),
                T.StructType(
                    [
                        T.StructField("id", T.StringType()),
                        T.StructField("parent", T.StringType()),
                        T.StructField("children", T.ArrayType(T.StringType())),
                        T.StructField("references", T.ArrayType(T.StringType())),
                        T.StructField("message", MESSAGE),
                    ]
                ),
            ),
        ),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
