"""A workspace: HR tables of a session and every operator over them."""

from __future__ import annotations

from datetime import date

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .operators import association, checks, cleaning, graph, models, slices
from .operators import mrqap as _mrqap
from .sources import tables

KINDS = ("hris", "compensation", "turnover", "survey", "retirement", "promotions", "skills", "attendance")


class Workspace:
    """Owns a session and the names of the tables loaded; ``persist`` saves tables instead of making views."""

    def __init__(self, spark: SparkSession | None = None, persist: bool = False):
        self.spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        self.persist = persist
        self.loaded: set[str] = set()

    def load(self, df: object, name: str) -> DataFrame:
        out = tables.register(self.spark, df, name, self.persist)
        self.loaded.add(name)
        return out

    def load_hris(self, df: object) -> DataFrame:
        out = tables.as_frame(self.spark, df)
        if "employee_id" not in out.columns:
            raise ValueError(f"column(s) not found in relation: ['employee_id']; available: {sorted(out.columns)}")
        return self.load(out, "hris")

    def table(self, name: str) -> DataFrame:
        return self.spark.table(tables.table_name(name))

    def sql(self, query: str) -> DataFrame:
        return self.spark.sql(query)

    def validate_keys(self, table_name: str, employee_id_col: str = "employee_id", date_col: str | None = None, *, date_lower: object = None, date_upper: object = None) -> None:
        if table_name not in self.loaded:
            raise ValueError(f"table {table_name!r} is not loaded")
        checks.validate_keys(self.table(table_name), employee_id_col, date_col, date_lower=date_lower, date_upper=date_upper, name=table_name)

    filter_noise = staticmethod(cleaning.filter_noise)
    deduplicate = staticmethod(cleaning.deduplicate)

    def build_org_edges(self, employee_id_col: str = "employee_id", supervisor_id_col: str = "supervisor_id", active_as_of: date | str | None = None, table_name: str = "hris", date_col: str | None = None) -> DataFrame:
        return cleaning.build_org_edges(self.table(table_name), employee_id_col, supervisor_id_col, active_as_of, date_col)

    betweenness = staticmethod(graph.betweenness)
    pagerank = staticmethod(graph.pagerank)
    eigenvector_centrality = staticmethod(graph.eigenvector_centrality)
    degree_centrality = staticmethod(graph.degree_centrality)
    connected_components = staticmethod(graph.connected_components)
    louvain_communities = staticmethod(graph.louvain_communities)
    shortest_path = staticmethod(graph.shortest_path)

    def join_hris(self, metrics: object, node_id_col: str = "node_id", employee_id_col: str = "employee_id", table_name: str = "hris", how: str = "inner") -> DataFrame:
        return cleaning.join_metrics(self.table(table_name), tables.as_frame(self.spark, metrics), employee_id_col, node_id_col, how)

    ols = staticmethod(models.ols)
    logistic = staticmethod(models.logistic)
    anova = staticmethod(models.anova)
    vif = staticmethod(models.vif)
    model_compare = staticmethod(models.model_compare)
    chi_square = staticmethod(association.chi_square)
    correlation = staticmethod(association.correlation)

    def build_temporal_slices(self, table_name: str, date_col: str, freq: str = "M") -> list[tuple[str, date, date, DataFrame]]:
        return slices.temporal_slices(self.table(table_name), date_col, freq)

    def mrqap(self, y: np.ndarray, x_matrices: list[np.ndarray], n_permutations: int = 1000, *, method: str = "pearson") -> dict:
        return _mrqap.mrqap(y, x_matrices, n_permutations, method=method, spark=self.spark)


def _loader(name: str):
    def load(self: Workspace, df: object) -> DataFrame:
        return self.load(df, name)

    load.__name__, load.__doc__ = f"load_{name}", f"Load or replace the table ``{name}``."
    return load


for _name in KINDS[1:]:
    setattr(Workspace, f"load_{_name}", _loader(_name))
