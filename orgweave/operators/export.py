"""Graphs as vertex and edge tables, and adapters to in-memory graph libraries where those are installed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ident import column, require_columns
from .graph import nodes_of
from .staging import stage


def graph_tables(edges: DataFrame, source_col: str, target_col: str, weight_col: str | None = None, node_attrs: DataFrame | None = None, node_id_col: str = "node_id", graph_type: str = "DiGraph") -> tuple[DataFrame, DataFrame]:
    """``(vertices, edges)``: vertices with their attributes, those without edges too; one edge a pair, the largest weight.

    ``graph_type`` "Graph" drops the direction.  Edges with a null end are dropped.
    """
    if graph_type not in ("DiGraph", "Graph"):
        raise ValueError("graph_type must be 'DiGraph' or 'Graph'")
    require_columns(edges, [source_col, target_col] + [weight_col] * (weight_col is not None))
    s, t = column(edges, source_col), column(edges, target_col)
    w = column(edges, weight_col) if weight_col else F.lit(None).cast("double")
    e = edges.select(s.alias("src"), t.alias("dst"), w.alias("weight")).dropna(subset=["src", "dst"])
    if graph_type == "Graph":
        e = e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")
    e = e.groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    e = e if weight_col else e.drop("weight")
    v = nodes_of(e).withColumnRenamed("node", node_id_col)
    if node_attrs is not None:
        require_columns(node_attrs, [node_id_col])
        v = v.join(node_attrs, node_id_col, "full_outer")
    return v, e


def indexed_graph(edges: DataFrame, source_col: str, target_col: str, weight_col: str | None = None, node_attrs: DataFrame | None = None, node_id_col: str = "node_id") -> tuple[DataFrame, DataFrame]:
    """``(vertices (index, name, attributes), edges (src, dst[, weight]))`` by position of the sorted names; parallel edges stay.

    The index comes from counts by range partition, not from one global sort task.
    """
    require_columns(edges, [source_col, target_col] + [weight_col] * (weight_col is not None))
    e = edges.select(column(edges, source_col).alias("s"), column(edges, target_col).alias("t"), *([column(edges, weight_col).alias("weight")] if weight_col else [])).dropna(subset=["s", "t"])
    names = nodes_of(e.select(F.col("s").alias("src"), F.col("t").alias("dst")))
    dealt = stage(names.repartitionByRange("node").select("node", F.spark_partition_id().alias("p")), "names")
    local = dealt.withColumn("i", F.row_number().over(Window.partitionBy("p").orderBy("node")))
    sizes = dealt.groupBy("p").agg(F.count("*").alias("k"))
    first = sizes.withColumn("before", F.coalesce(F.sum("k").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    v = local.join(F.broadcast(first), "p").select((F.col("i") + F.col("before") - 1).alias("index"), F.col("node").alias("name"))
    at = lambda c: v.select(F.col("index").alias(c), F.col("name").alias(f"{c}_name"))
    out = e.join(at("src"), F.col("s") == F.col("src_name")).join(at("dst"), F.col("t") == F.col("dst_name")).select("src", "dst", *(["weight"] if weight_col else []))
    if node_attrs is not None:
        require_columns(node_attrs, [node_id_col])
        v = v.join(node_attrs.withColumnRenamed(node_id_col, "name"), "name", "left").select("index", "name", *(c for c in node_attrs.columns if c != node_id_col))
    return v, out


def to_networkx(edges: DataFrame, source_col: str, target_col: str, weight_col: str | None = None, graph_type: str = "DiGraph", node_attrs: DataFrame | None = None, node_id_col: str = "node_id"):
    """A networkx graph of the tables of ``graph_tables``, gathered on the driver."""
    v, e = graph_tables(edges, source_col, target_col, weight_col, node_attrs, node_id_col, graph_type)
    try:
        import networkx
    except ImportError as x:
        raise ImportError("to_networkx needs networkx; graph_tables gives the same as DataFrames") from x
    g = getattr(networkx, graph_type)()
    for r in v.toLocalIterator():
        d = r.asDict()
        g.add_node(d.pop(node_id_col), **{k: x for k, x in d.items() if x is not None})
    for r in e.toLocalIterator():
        g.add_edge(r["src"], r["dst"], **({"weight": r["weight"]} if weight_col else {}))
    return g


def to_igraph(edges: DataFrame, source_col: str, target_col: str, weight_col: str | None = None, directed: bool = True, node_attrs: DataFrame | None = None, node_id_col: str = "node_id"):
    """An igraph graph of the tables of ``indexed_graph``, gathered on the driver."""
    v, e = indexed_graph(edges, source_col, target_col, weight_col, node_attrs, node_id_col)
    try:
        import igraph
    except ImportError as x:
        raise ImportError("to_igraph needs igraph; indexed_graph gives the same as DataFrames") from x
    rows, links = v.orderBy("index").collect(), e.collect()
    g = igraph.Graph(n=len(rows), edges=[(r["src"], r["dst"]) for r in links], directed=directed)
    for c in v.columns[1:]:
        g.vs[c] = [r[c] for r in rows]
    if weight_col:
        g.es["weight"] = [r["weight"] for r in links]
    return g
