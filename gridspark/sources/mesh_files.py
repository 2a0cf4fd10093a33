"""Meshes in classic netCDF files: topology by attribute, nodes and connectivities by name."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import SparkSession

from ..frame import GridError, local_table
from ..operators.mesh import ROLES, Connectivity, Mesh
from . import netcdf3
from .store import _filesystem, expand


def load_meshes(spark: SparkSession, path: str, var_name: str | None = None) -> dict[str, Mesh]:
    """Every mesh of the files by its variable's name, or the one named."""
    out = {}
    for p in expand(spark, [path]):
        data = bytes(spark.read.format("binaryFile").load(p).select("content").head()[0])
        h = netcdf3.read_header(data)
        for v in h.variables.values():
            if v.attributes.get("cf_role") != "mesh_topology" or var_name not in (None, v.name):
                continue
            x, y = (np.asarray(netcdf3.read_array(data, h, h.variables[n]), float) for n in v.attributes["node_coordinates"].split())
            nodes = local_table(spark, [(k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y))], "node int, x double, y double")
            links = []
            for role in ROLES:
                if role in v.attributes and v.attributes[role] in h.variables:
                    c = h.variables[v.attributes[role]]
                    links.append(Connectivity.from_array(spark, role, netcdf3.read_array(data, h, c), int(c.attributes.get("start_index", 0))))
            centres = {}
            for place in ("edge", "face"):
                names = str(v.attributes.get(f"{place}_coordinates", "")).split()
                if len(names) == 2 and all(n in h.variables for n in names):
                    cx, cy = (np.asarray(netcdf3.read_array(data, h, h.variables[n]), float) for n in names)
                    centres[place] = local_table(spark, [(k, float(a), float(b)) for k, (a, b) in enumerate(zip(cx, cy))], "loc int, x double, y double")
            out[v.name] = Mesh(nodes, tuple(links), centres, int(v.attributes.get("topology_dimension", 2)))
    return out


def load_mesh(spark: SparkSession, path: str, var_name: str | None = None) -> Mesh:
    found = load_meshes(spark, path, var_name)
    if len(found) != 1:
        raise GridError(f"{len(found)} meshes where one should be")
    return next(iter(found.values()))


def save_mesh(mesh: Mesh, path: str) -> None:
    """Write a mesh alone; its tables meet on the driver, as one file needs."""
    spark = mesh.nodes.sparkSession
    nodes = mesh.nodes.orderBy("node").toPandas()
    arrays = {"node_x": (("node",), nodes.x.to_numpy(">f8"), {"units": "degrees"}), "node_y": (("node",), nodes.y.to_numpy(">f8"), {"units": "degrees"})}
    dims, own = {"node": len(nodes), "one": 1}, {"cf_role": "mesh_topology", "topology_dimension": mesh.topology_dimension, "node_coordinates": "node_x node_y"}
    for c in mesh.connectivities:
        t = c.df.toPandas()
        a = np.full((int(t["loc"].max()) + 1, int(t["pos"].max()) + 1), -1, ">i4")
        there = t[t.target.notna()]
        a[there["loc"].to_numpy(), there["pos"].to_numpy()] = there.target.to_numpy()
        place = c.role.split("_")[0]
        dims[place], dims[f"{c.role}_width"] = a.shape
        arrays[c.role] = ((place, f"{c.role}_width"), a, {"cf_role": c.role, "start_index": 0, "_FillValue": -1})
        own[c.role] = c.role
    for place, df in mesh.centres.items():
        t = df.orderBy("loc").toPandas()
        dims[place] = len(t)
        own[f"{place}_coordinates"] = f"{place}_x {place}_y"
        arrays[f"{place}_x"], arrays[f"{place}_y"] = ((place,), t.x.to_numpy(">f8"), {}), ((place,), t.y.to_numpy(">f8"), {})
    arrays["mesh"] = (("one",), np.zeros(1, ">i4"), own)
    order = list(dims)
    head = b"CDF\2" + struct.pack(">i", 0) + struct.pack(">ii", netcdf3.DIMENSION, len(order)) + b"".join(netcdf3._text(d) + struct.pack(">i", dims[d]) for d in order) + netcdf3._attributes({})

    def table(begins: dict[str, int]) -> bytes:
        out = struct.pack(">ii", netcdf3.VARIABLE, len(arrays))
        for n, (d, a, x) in arrays.items():
            out += netcdf3._text(n) + struct.pack(">i", len(d)) + b"".join(struct.pack(">i", order.index(k)) for k in d) + netcdf3._attributes(x)
            out += struct.pack(">ii", netcdf3.CODES[a.dtype.str[1:]], a.nbytes + (-a.nbytes % 4)) + struct.pack(">q", begins.get(n, 0))
        return out

    at, begins = len(head) + len(table({})), {}
    for n, (_, a, _) in arrays.items():
        begins[n] = at
        at += a.nbytes + (-a.nbytes % 4)
    fs, target = _filesystem(spark, path)
    stream = fs.create(target, True)
    try:
        stream.write(head + table(begins) + b"".join(a.tobytes() + bytes(-a.nbytes % 4) for _, a, _ in arrays.values()))
    finally:
        stream.close()
