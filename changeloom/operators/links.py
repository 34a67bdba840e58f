"""Edges between every importer and every file of a node, kept as two tables that grow with their rows.

A graph in two parts is (change_id, node, importer) and (change_id, node, imported). The nodes of one
importer share no file, so importers times files of each node are distinct as they are: no step
shuffles or sorts that product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from changeloom.sources.shared import materialize

EDGE = ["change_id", "importer", "imported"]
Links = tuple[DataFrame, DataFrame]


def asked_members(links: Links) -> Links:
    """The same links without nodes that nobody imports."""
    asks, members = links
    return asks, members.join(asks, ["change_id", "node"], "left_semi")


def expand_links(links: Links) -> DataFrame:
    """Distinct (change_id, importer, imported): importers times files of each node."""
    asks, members = links
    return asks.distinct().join(members.distinct(), ["change_id", "node"]).where("importer <> imported").select(*EDGE)


def all_edges(edges: DataFrame, links: Links) -> DataFrame:
    """Distinct (change_id, importer, imported) of edges and links; edges which the links have leave before the union."""
    asks, members = links
    edges = materialize(edges.select(*EDGE).distinct(), "single-edges")
    linked = edges.join(members, ["change_id", "imported"]).join(asks, ["change_id", "node", "importer"], "left_semi")
    rest = edges.join(linked.where("importer <> imported").select(*EDGE).distinct(), EDGE, "left_anti")
    return rest.unionByName(expand_links(links))
