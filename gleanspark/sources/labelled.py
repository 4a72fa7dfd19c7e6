"""Labelled text tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def labelled(df: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """Keep ``id, text, label`` of a table under these names."""
    return df.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.col(text_col).alias("text"),
        F.col(label_col).cast("int").alias("label"),
    )


def read_labelled(
    spark: SparkSession,
    path: str,
    id_col: str = "id",
    text_col: str = "text",
    label_col: str = "label",
    source_format: str = "parquet",
) -> DataFrame:
    """Read a labelled table in any format Spark has a reader for."""
    return labelled(spark.read.format(source_format).load(path), id_col, text_col, label_col)


def attach_labels(texts: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """Labels kept in a table of their own; texts without one are left out."""
    return labelled(texts.join(labels.select(id_col, label_col), id_col), id_col, "text", label_col)


def union_all(*parts: DataFrame | None) -> DataFrame:
    """Bag union by column name: copies stay, parts given as None are skipped."""
    given = [p for p in parts if p is not None]
    if not given:
        raise ValueError("nothing to union")
    union = given[0]
    for part in given[1:]:
        union = union.unionByName(part)
    return union


def union_keyed(parts: Mapping[str, DataFrame], id_col: str = "id") -> DataFrame:
    """Union of named sources whose ids may collide: ``key`` is the source and the id."""
    key = lambda name: F.concat(F.lit(f"{name}:"), F.col(id_col).cast("string"))
    return union_all(*[part.withColumn("key", key(name)) for name, part in parts.items()])


def unique(df: DataFrame, id_col: str) -> DataFrame:
    """``df`` as it is, or an error if rows share an id or have none."""
    repeated = F.col("count") > 1
    bad = df.groupBy(id_col).count().filter(repeated | F.col(id_col).isNull()).limit(1).collect()
    if bad:
        raise ValueError(f"{id_col} {bad[0][0]} does not name one row; see union_keyed")
    return df
