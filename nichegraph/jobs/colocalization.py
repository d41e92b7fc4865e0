"""The gene graph from kept pairs to modules: centrality, archetypes, membership and enrichment in one call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from nichegraph.operators import enrichment, graph


@dataclass(frozen=True)
class GeneGraph:
    """Tables of a graph; centrality and enrichment are None unless asked for."""

    edges: DataFrame
    vertices: DataFrame
    w: DataFrame
    h: DataFrame
    modules_w: DataFrame
    modules_h: DataFrame
    membership: DataFrame
    centrality: DataFrame | None
    enrichment: DataFrame | None


def gene_graph(pairs: DataFrame, k: int = 25, w_threshold: float = 0.3, h_threshold: float = 0.005, seed: int = 42, with_centrality: bool = False, terms: DataFrame | None = None, module_source: str = "W", top_n: int = 20) -> GeneGraph:
    """The graph of kept pairs with its k modules by W and by H.

    terms: gene sets (term, genes) that the modules of module_source are tested for against all genes of the
    graph; every module has a row at least. ValueError if no pair is kept or module_source is neither W nor H.
    """
    if module_source not in ("W", "H"):
        raise ValueError("module_source is W or H")
    edges = graph.graph_edges(pairs.persist(), required=True).persist()  # a row per pair of genes, read by all that follows
    genes, found = graph.vertices(edges), graph.archetypes(edges, k, seed=seed).persist()
    w, h = (found.filter(f"matrix = '{m}'").drop("matrix") for m in "WH")
    of = {"W": graph.all_modules(w, k, w_threshold), "H": graph.all_modules(h, k, h_threshold)}
    tested = None if terms is None else enrichment.enriched_modules(of[module_source], terms, genes, top_n)
    return GeneGraph(edges, genes, w, h, of["W"], of["H"], graph.membership(genes, w, w_threshold), graph.centrality(edges) if with_centrality else None, tested)
