"""Unstructured meshes: nodes, edges, faces as tables; coordinates by joins over connectivities."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import Coord, Grid, GridError, local_table, sized

#: What a connectivity maps from and to.
ROLES = ("edge_node_connectivity", "face_node_connectivity", "face_edge_connectivity", "face_face_connectivity", "edge_face_connectivity", "boundary_node_connectivity", "volume_node_connectivity", "volume_edge_connectivity", "volume_face_connectivity", "volume_volume_connectivity")


@dataclass(frozen=True)
class Connectivity:
    """Long table (loc, pos, target): the target at a position of a location; a null target is absent."""

    role: str
    df: DataFrame
    start_index: int = 0
    location_axis: int = 0

    def __post_init__(self):
        if self.role not in ROLES or self.start_index not in (0, 1) or self.location_axis not in (0, 1):
            raise GridError(f"no connectivity of role {self.role!r}, start {self.start_index}, axis {self.location_axis}")

    @staticmethod
    def from_array(spark: SparkSession, role: str, indices, start_index: int = 0, location_axis: int = 0) -> Connectivity:
        """From a two-axis array; negative or masked entries are absent."""
        a = np.ma.filled(np.ma.asarray(indices), -1)
        a = a.T if location_axis == 1 else a
        rows = [(i, j, int(x) - start_index if x >= start_index else None) for i, r in enumerate(a.tolist()) for j, x in enumerate(r)]
        return Connectivity(role, local_table(spark, rows, "loc int, pos int, target int"), start_index, location_axis)

    def lengths(self) -> DataFrame:
        """How many targets each location has."""
        return self.df.groupBy("loc").agg(F.count("target").alias("n"))

    def transposed(self) -> Connectivity:
        return replace(self, location_axis=1 - self.location_axis)


@dataclass(frozen=True)
class Mesh:
    """Nodes (node, x, y) with connectivities and optional centres of edges and faces."""

    nodes: DataFrame
    connectivities: tuple[Connectivity, ...] = ()
    centres: dict[str, DataFrame] = field(default_factory=dict)
    topology_dimension: int = 2

    def connectivity(self, role: str) -> Connectivity:
        found = [c for c in self.connectivities if c.role == role]
        if len(found) != 1:
            raise GridError(f"{len(found)} connectivities are {role}")
        return found[0]

    @staticmethod
    def from_bounds(spark: SparkSession, x: Coord, y: Coord) -> Mesh:
        """A mesh from coordinates with corner bounds: equal corners become one node."""
        if x.bounds is None or y.bounds is None or x.bounds.shape != y.bounds.shape:
            raise GridError("both coordinates need bounds of one shape")
        k = x.bounds.shape[-1]
        bx, by = x.bounds.reshape(-1, k).astype(float), y.bounds.reshape(-1, k).astype(float)
        rows = [(i, j, a, b) for i, (r, s) in enumerate(zip(bx.tolist(), by.tolist())) for j, (a, b) in enumerate(zip(r, s))]
        corners = local_table(spark, rows, "loc int, pos int, x double, y double")
        distinct = np.unique(np.stack([bx.ravel(), by.ravel()], axis=1), axis=0)
        nodes = local_table(spark, [(n, float(a), float(b)) for n, (a, b) in enumerate(distinct)], "node int, x double, y double")
        role = "edge_node_connectivity" if k == 2 else "face_node_connectivity"
        links = corners.join(sized(nodes, len(distinct)), ["x", "y"]).select("loc", "pos", F.col("node").alias("target"))
        place = "edge" if k == 2 else "face"
        centres = local_table(spark, [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x.points.ravel(), y.points.ravel()))], "loc int, x double, y double")
        return Mesh(nodes, (Connectivity(role, links),), {place: centres}, 1 if k == 2 else 2)

    def corners(self, location: str) -> DataFrame:
        """loc, and its nodes' coordinates in order as arrays."""
        if location == "node":
            return self.nodes.select(F.col("node").alias("loc"), F.array("x").alias("xs"), F.array("y").alias("ys"))
        links = self.connectivity(f"{location}_node_connectivity").df.where("target is not null")
        at = links.join(self.nodes, links["target"] == self.nodes["node"]).groupBy("loc").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("_c"))
        return at.select("loc", F.col("_c.x").alias("xs"), F.col("_c.y").alias("ys"))

    def points(self, location: str) -> DataFrame:
        """loc, x, y of a location: its own centres if given, else the mean of its nodes."""
        if location == "node":
            return self.nodes.select(F.col("node").alias("loc"), "x", "y")
        if location in self.centres:
            return self.centres[location]
        mean = lambda c: F.expr(f"aggregate({c}, 0D, (a, v) -> a + v) / size({c})")
        return self.corners(location).select("loc", mean("xs").alias("x"), mean("ys").alias("y"))

    def face_areas(self) -> DataFrame:
        """Planar areas of the faces."""
        ring = "aggregate(sequence(0, size(xs) - 1), 0D, (a, k) -> a + xs[k] * ys[(k + 1) % size(xs)] - xs[(k + 1) % size(xs)] * ys[k])"
        return self.corners("face").select("loc", F.expr(f"abs({ring}) / 2").alias("area"))

    def edges_of_faces(self) -> DataFrame:
        """The distinct edges (a, b) that bound faces, with the number of faces each has."""
        c = self.connectivity("face_node_connectivity").df.where("target is not null")
        ring = c.groupBy("loc").agg(F.array_sort(F.collect_list(F.struct("pos", "target"))).alias("_r")).select("loc", F.col("_r.target").alias("r"))
        pairs = ring.select(F.explode(F.expr("transform(sequence(0, size(r) - 1), k -> struct(least(r[k], r[(k + 1) % size(r)]) as a, greatest(r[k], r[(k + 1) % size(r)]) as b))")).alias("e"))
        return pairs.groupBy("e.a", "e.b").agg(F.count("*").alias("n_faces"))


def extract_region(grid: Grid, dim: str, mesh: Mesh, x_range: tuple[float, float], y_range: tuple[float, float], location: str = "face") -> DataFrame:
    """The cells of a mesh field whose location's point lies in a box."""
    inside = mesh.points(location).where(F.col("x").between(*x_range) & F.col("y").between(*y_range)).select(F.col("loc").alias(f"i_{dim}"))
    return grid.df.join(inside, f"i_{dim}", "left_semi")


def recombine_submeshes(full: Grid, parts: Sequence[Grid], dim: str, index_coord: str = "i_mesh_index") -> Grid:
    """Parts scattered onto the full mesh by their index coordinate; later parts win, uncovered cells are masked."""
    rows = None
    for k, p in enumerate(parts):
        c = p.coord(index_coord)
        (d,) = c.dims
        table = local_table(full.spark, [(i, int(x)) for i, x in enumerate(c.points)], f"`i_{d}` int, _full int")
        own = p.df.join(sized(table, len(c.points)), f"i_{d}").drop(f"i_{d}").withColumnRenamed("_full", f"i_{dim}").withColumn("_k", F.lit(k)).select(*full.keys(), "v", "_k")
        rows = own if rows is None else rows.unionByName(own)
    best = rows.groupBy(*full.keys()).agg(F.max_by("v", "_k").alias("v"))
    first = parts[0]
    return replace(first, df=best, dims=dict(full.dims), coords=full.coords)
