"""Typed loads: one declared type per column, a cell that does not fit becomes NULL."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The study's columns and types. Ids and codes are whole numbers, the
# cohort is text, everything else is a double.
STUDY_TYPES = {
    "participant_id": "bigint", "source": "string", "wave": "int",
    "tumortype": "int", "stage_tnm": "int", "stage_annarbor": "int",
    "radiotherapy": "int", "surgery": "int", "systemic": "int", "under_treatment": "int",
    "sex": "int", "education": "int", "partner": "int", "smoking": "int", "alcoholuse": "int",
}
QUESTIONNAIRE_SCALES = ["ql", "pf", "rf", "ef", "cf", "sf", "fa", "nv", "pa", "dy", "sl", "ap", "co", "di", "fi"]


def _typed(column: str, type_: str) -> Column:
    if type_ == "string":
        return F.col(column).cast("string")
    text = F.trim(F.col(column).cast("string"))
    if type_ in ("int", "bigint"):
        # "3.0" is the whole number 3; 3.5 does not fit
        number = F.expr(f"try_cast({_quote(column)} AS DECIMAL(38, 6))")
        whole = F.when(number == F.floor(number), number)
        return F.coalesce(text.try_cast(type_), whole.try_cast(type_))
    value = text.try_cast(type_)
    return F.when(~F.isnan(value), value) if type_ in ("double", "float") else value


def _quote(column: str) -> str:
    return f"trim(CAST(`{column}` AS STRING))"


def apply_types(df: DataFrame, types: Mapping[str, str], default: str | None = None) -> DataFrame:
    """Cast by name; columns not listed keep their type, or take ``default``."""
    return df.select(*[
        _typed(c, types.get(c, default)).alias(c) if types.get(c, default) else F.col(c) for c in df.columns
    ])


def load_csv(spark: SparkSession, path: str, types: Mapping[str, str] = STUDY_TYPES, default: str = "double") -> DataFrame:
    """A CSV export with a header. Read as text in one pass, never with type inference."""
    return apply_types(spark.read.option("header", True).csv(path), types, default)


def load_parquet(spark: SparkSession, path: str, types: Mapping[str, str] = STUDY_TYPES, default: str | None = None) -> DataFrame:
    return apply_types(spark.read.parquet(path), types, default)
