"""Train/test column alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_NOT_FEATURES = {"session_id", "user_id"}


def feature_union(*tables: DataFrame) -> list[str]:
    """Feature names found in any table, in string order."""
    names = {c for table in tables for c in table.columns}
    return sorted(names - _NOT_FEATURES)


def project_features(table: DataFrame, features: list[str], labelled: bool) -> DataFrame:
    """``session_id``, the given features as doubles, the label.

    A feature the table lacks, a NULL and a NaN all become 0. Reconciling with a
    schema adds, orders and casts everything in one projection, so both sides
    end up with exactly the same types.
    """
    columns = [T.StructField("session_id", T.StringType())]
    columns += [T.StructField(name, T.DoubleType()) for name in features]
    if labelled:
        columns.append(T.StructField("user_id", T.StringType()))
    return table.to(T.StructType(columns)).na.fill(0.0, subset=features)


def align_train_test_features(
    train: DataFrame, test: DataFrame
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both tables with the same features in the same order, and their names."""
    features = feature_union(train, test)
    return (
        project_features(train, features, labelled=True),
        project_features(test, features, labelled=False),
        features,
    )
