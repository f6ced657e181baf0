"""Flow feature files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

_RAW = "__raw_record"
#: A separator outside quotes.
_COMMA = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def read_flows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with a header. Short rows are filled with NULL, rows with more fields than the header are dropped.

    Values stay text until aligned. Every record is parsed as a whole, whatever columns are selected later, so
    the rows are the same for any selection.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, _RAW]])
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _RAW)
    rows = reader.option("columnPruning", False).option("enforceSchema", False).schema(schema).csv(path)
    fields = F.size(F.split(F.col(_RAW), _COMMA, -1))
    # Spark refuses plans that read nothing but the raw record, so the first column takes part too
    some = F.length(F.coalesce(columns[0], F.lit(""))) >= 0
    return rows.where((F.col(_RAW).isNull() | (fields <= len(columns))) & some).select(*columns)
