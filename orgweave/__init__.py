"""Spark-native people analytics and organisational network analysis.

Names are imported on first use, so a Python worker loads only the modules it runs.
"""

from importlib import import_module

__version__ = "0.1.0"

_HOMES = {
    "operators.association": ("chi_square", "correlation"),
    "operators.cleaning": ("build_org_edges", "deduplicate", "filter_noise", "join_metrics"),
    "operators.export": ("graph_tables", "indexed_graph", "to_igraph", "to_networkx"),
    "operators.graph": ("betweenness", "connected_components", "degree_centrality", "eigenvector_centrality", "louvain_communities", "pagerank", "shortest_path"),
    "operators.hierarchy": ("hierarchy_long", "hierarchy_stats", "hierarchy_valid", "hierarchy_wide"),
    "operators.models": ("anova", "augment", "fit_logistic", "fit_ols", "logistic", "model_compare", "ols", "vif"),
    "operators.mrqap": ("mrqap",),
    "operators.plots": ("plot_coefficients", "plot_ols", "plot_residuals", "save_figure"),
    "operators.slices": ("label_slices", "temporal_slices"),
    "sources.tables": ("tidy_to_duckdb", "tidy_to_table", "to_duckdb", "to_table"),
    "workspace": ("Workspace",),
}
_HOME = {name: home for home, names in _HOMES.items() for name in names} | {"model_compare_stats": "operators.models"}
__all__ = ["__version__", *_HOME]


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_HOME[name]}"), "model_compare" if name == "model_compare_stats" else name)
