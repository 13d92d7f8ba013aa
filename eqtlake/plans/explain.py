"""What a plan does, for tests and tuning."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame


def plan_text(df: DataFrame) -> str:
    """The formatted physical plan."""
    jvm = df.sparkSession.sparkContext._jvm
    mode = jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def operators(df: DataFrame) -> Counter[str]:
    """How often each physical operator is in the plan."""
    head = plan_text(df).split("\n\n")[0]
    return Counter(re.findall(r"^[\s:|*+-]*(?:\* )?([A-Z]\w+)", head, re.M))


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[(.*)\]", plan_text(df))


def partition_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PartitionFilters: \[(.*)\]", plan_text(df))


def read_schemas(df: DataFrame) -> list[str]:
    return re.findall(r"ReadSchema: (struct<.*>)", plan_text(df))
