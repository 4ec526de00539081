"""The deconvolution run as one object: all samples, one lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spotweave.operators import deconv, filters, normalize, spatial
from spotweave.session import stored
from spotweave.sources import sinks
from spotweave.sources.text import marker_table


class SpotModel:
    """Proportions and expression per cell type for every spot of every sample.

    ``expr`` and ``protein`` are long tables of counts, ``spots`` the dense
    table of spots with coordinates. Methods return DataFrames and keep what
    later steps need; loops over samples are never needed, ``sample`` is a key.
    """

    def __init__(self, expr: DataFrame, protein: DataFrame, spots: DataFrame):
        self.spark = expr.sparkSession
        self.expr, self.protein, self.spots = expr, protein, spots
        self.counts = expr
        self.profile: dict[str, dict[str, list[str]]] = {}
        self.global_props: DataFrame | None = None
        self.fine_props: DataFrame | None = None

    @property
    def types(self) -> list[str]:
        return sorted(self.profile)

    def load_profile(self, profile: dict[str, dict[str, list[str]]]) -> None:
        """Marker profile: cell type to ``{"Major": [proteins]}``."""
        if not profile:
            raise ValueError("the profile names no cell type")
        self.profile = profile

    def check_inputs(self) -> DataFrame:
        """Negative, NaN and missing values per sample and table."""
        parts = [
            filters.data_checks(df).withColumn("source", F.lit(name))
            for name, df in (("expr", self.expr), ("protein", self.protein))
        ]
        return parts[0].unionByName(parts[1])

    def filter_gex(self, nonzero_percentage: float = 0.01, mean_expression_threshold: float = 1.1) -> DataFrame:
        self.expr = filters.filter_gex(
            self.expr, nonzero_percentage, mean_expression_threshold, cells=self.spots
        )
        self.counts = self.expr
        return self.expr

    def filter_min_counts(self, min_counts: float) -> DataFrame:
        self.expr = filters.filter_min_counts(self.expr, min_counts)
        self.counts = self.expr
        return self.expr

    def preprocess_gex(self, target_sum: float | None = 10000.0) -> DataFrame:
        """Library-size scaling; expression is split on this scale."""
        self.expr = normalize.normalize_total(self.expr, target_sum, log=False)
        return self.expr

    def preprocess_antibody(
        self, lower: float = 0.05, upper: float = 0.95, proteins: DataFrame | None = None
    ) -> normalize.ClrParts:
        """Winsorised centred log ratio, kept sparse; ``antibody_clr`` gives it as a dense table."""
        panel = self.protein.select("protein").distinct() if proteins is None else proteins
        self.clr = normalize.clr_parts(self.protein, self.spots, panel, lower, upper)
        return self.clr

    def run_proportions(
        self,
        radius: float = 4.0,
        lambda_reg: float = 0.001,
        alpha: float = 0.7,
        max_y_change: float = 0.2,
        tolerance: float = 1e-4,
        max_iterations: int = 20,
        n_markers: int | None = None,
    ) -> tuple[DataFrame, DataFrame]:
        """(global, fine-tuned) proportions, long."""
        marker = marker_table(self.spark, self.profile, n_markers)
        self.global_props = stored(
            deconv.marker_props_sparse(self.clr, marker, self.types), "global_props"
        )
        self.fine_props = deconv.refine_props(
            self.global_props,
            self.spots,
            self.types,
            radius,
            {"lam": lambda_reg, "alpha": alpha, "cap": max_y_change},
            tolerance,
            max_iterations,
        )
        return deconv.to_long(self.global_props, self.types), deconv.to_long(self.fine_props, self.types)

    def run_sweep(self, points: list[dict], radius: float = 4.0, tolerance: float = 1e-4, max_iterations: int = 20) -> DataFrame:
        """Fine-tuned proportions for many parameter points in one job, long with ``run_id``.

        ``points`` come from ``sweep_points(lam=..., alpha=..., cap=...)``.
        """
        if self.global_props is None:
            raise RuntimeError("run_proportions comes first")
        wide = deconv.refine_props(
            self.global_props, self.spots, self.types, radius, points, tolerance, max_iterations
        )
        return deconv.to_long(wide, self.types, ("run_id", "sample", "spot"))

    def _props(self) -> DataFrame:
        if self.fine_props is None:
            raise RuntimeError("run_proportions comes first")
        return self.fine_props

    def append_proportions(self, key: str = "finetuned") -> DataFrame:
        """Spot table with one proportion column per type."""
        wide = self._props() if key == "finetuned" else self.global_props
        return spatial.append_props(self.spots, deconv.to_long(wide, self.types), self.types)

    def run_expression_pass1(
        self, radius: float | None = None, output_dir: str | None = None, rerun: bool = True
    ) -> DataFrame:
        """Expression per type; ``radius`` uses local profiles.

        With ``output_dir`` finished samples are kept there and skipped when
        ``rerun`` is false.
        """

        def split(expr: DataFrame) -> DataFrame:
            if radius is None:
                return deconv.expr_pass1(expr, self._props(), self.types)
            return deconv.expr_pass1_local(expr, self._props(), self.spots, self.types, radius)

        if output_dir is None:
            return split(self.expr)
        return sinks.run_stage(self.expr, split, output_dir, ["sample"], rerun)

    def expression_prior(self, pass1: DataFrame) -> DataFrame:
        return deconv.expr_prior(pass1, deconv.to_long(self._props(), self.types, keep_zero=False))

    def run_expression_pass2(self, prior: DataFrame | None = None, prior_weight: float = 0.5) -> DataFrame:
        return deconv.expr_pass2(self.expr, self._props(), self.types, prior_weight, prior)
