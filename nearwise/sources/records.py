"""Record tables: CSV in and out, and the mapping table kept beside the vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from nearwise.functions.tags import tags_literal

RECORD_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("name", "state", "description", "tags")]
)
# The cell texts that the usual data-frame CSV readers take for missing.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
MAPPING_COLUMNS = ("doc_id", "facet", "name", "description", "tags", "combined_text")


def read_records_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType = RECORD_SCHEMA,
    null_tokens: Sequence[str] = NULL_TOKENS,
) -> DataFrame:
    """Records from CSV with a header, quoted line breaks and doubled quotes; null tokens become null.

    Quoted line breaks keep Spark from splitting one file, so large inputs should come as many files.
    """
    raw = (
        spark.read.schema(schema)
        .options(header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST")
        .csv(path)
    )
    tokens = list(null_tokens)
    texts = [field.name for field in schema.fields if isinstance(field.dataType, T.StringType)]
    return raw.withColumns({name: F.when(~F.col(name).isin(tokens), F.col(name)) for name in texts})


def write_records_csv(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Records as CSV; array columns are written as list literals."""
    arrays = [f.name for f in records.schema.fields if isinstance(f.dataType, T.ArrayType)]
    flat = records.withColumns({name: tags_literal(F.col(name)) for name in arrays})
    flat.write.mode(mode).options(header=True, quote='"', escape='"', quoteAll=True).csv(path)


def corpus_mapping(corpus: DataFrame) -> DataFrame:
    """The columns needed to show a hit, with its key and facet."""
    return corpus.select(*MAPPING_COLUMNS)
