"""Results of other tools in the common long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from spotweave.functions.scalar import last_token
from spotweave.operators.deconv import weighted_layers
from spotweave.operators.normalize import normalize_rows

SPOT = ("sample", "spot")


def abundance_props(abundance: DataFrame, by: Sequence[str] = SPOT) -> DataFrame:
    """Cell abundance to proportions: types named by the last ``_`` token, a zero row is NaN."""
    named = abundance.withColumn("cell_type", last_token(F.col("cell_type")))
    return normalize_rows(named, by, "p", "nan")


def mapping_props(mapping: DataFrame, by: Sequence[str] = SPOT) -> DataFrame:
    """Mapped cell counts to proportions; a zero row stays 0."""
    return normalize_rows(mapping, by, "p", "zero")


def mapping_layers(expr: DataFrame, mapping: DataFrame) -> DataFrame:
    """Expression times mapped weight per type, gene names in upper case."""
    return weighted_layers(expr, mapping).withColumn("gene", F.upper("gene"))


def label_scores(scores: DataFrame, types: Sequence[str], by: Sequence[str] = SPOT) -> DataFrame:
    """Prediction scores limited to the wanted types."""
    return scores.where(F.col("cell_type").isin(list(types))).select(*by, "cell_type", "p")
