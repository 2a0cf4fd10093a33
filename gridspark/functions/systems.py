"""Coordinate systems as metadata, which fields keep, compare and store; ``projections`` computes with them."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np


@dataclass(frozen=True)
class CoordSystem:
    """Base of all systems; equal when kind and parameters are equal."""

    def describe(self) -> dict:
        return {"grid_mapping_name": type(self).grid_mapping_name, **{k: v for k, v in asdict(self).items() if v is not None}}

    grid_mapping_name = ""


@dataclass(frozen=True)
class GeogCS(CoordSystem):
    """A sphere or an ellipsoid; give one axis, or the major axis with the minor or the inverse flattening."""

    semi_major_axis: float | None = None
    semi_minor_axis: float | None = None
    inverse_flattening: float | None = None
    longitude_of_prime_meridian: float = 0.0
    grid_mapping_name = "latitude_longitude"

    def __post_init__(self):
        a, b, f = self.semi_major_axis, self.semi_minor_axis, self.inverse_flattening
        if a is None and b is None:
            raise ValueError("an axis is needed")
        if a is not None and b is not None and f is not None:
            raise ValueError("the ellipsoid is overspecified")
        if f is not None:
            if a is None:
                a = b / (1 - 1 / f) if f else b
            b = a - a / f if f else a
        elif a is None or b is None:
            a = b = a if a is not None else b
        object.__setattr__(self, "semi_major_axis", float(a))
        object.__setattr__(self, "semi_minor_axis", float(b))
        object.__setattr__(self, "inverse_flattening", 0.0 if a == b else float(1 / ((a - b) / a)))


@dataclass(frozen=True)
class RotatedGeogCS(CoordSystem):
    grid_north_pole_latitude: float = 90.0
    grid_north_pole_longitude: float = 0.0
    north_pole_grid_longitude: float = 0.0
    ellipsoid: GeogCS | None = None
    grid_mapping_name = "rotated_latitude_longitude"

    def to_true(self, rlon, rlat) -> tuple[np.ndarray, np.ndarray]:
        """Rotated coordinates, in degrees, as true longitude and latitude."""
        a, b = np.radians(np.asarray(rlon, float) - self.north_pole_grid_longitude), np.radians(np.asarray(rlat, float))
        t = np.radians(90.0 - self.grid_north_pole_latitude)
        x, y, z = np.cos(b) * np.cos(a), np.cos(b) * np.sin(a), np.sin(b)
        lon = np.degrees(np.arctan2(y, np.cos(t) * x - np.sin(t) * z)) + self.grid_north_pole_longitude + 180.0
        return (lon + 180.0) % 360.0 - 180.0, np.degrees(np.arcsin(np.clip(np.sin(t) * x + np.cos(t) * z, -1, 1)))


@dataclass(frozen=True)
class TransverseMercator(CoordSystem):
    latitude_of_projection_origin: float = 0.0
    longitude_of_central_meridian: float = 0.0
    false_easting: float = 0.0
    false_northing: float = 0.0
    scale_factor_at_central_meridian: float = 1.0
    ellipsoid: GeogCS | None = None
    grid_mapping_name = "transverse_mercator"


def osgb() -> TransverseMercator:
    """The British national grid."""
    return TransverseMercator(49.0, -2.0, 400_000.0, -100_000.0, 0.9996012717, GeogCS(6_377_563.396, 6_356_256.909))


@dataclass(frozen=True)
class Orthographic(CoordSystem):
    latitude_of_projection_origin: float = 0.0
    longitude_of_projection_origin: float = 0.0
    false_easting: float = 0.0
    false_northing: float = 0.0
    ellipsoid: GeogCS | None = None
    grid_mapping_name = "orthographic"


@dataclass(frozen=True)
class VerticalPerspective(CoordSystem):
    latitude_of_projection_origin: float = 0.0
    longitude_of_projection_origin: float = 0.0
    perspective_point_height: float = 0.0
    false_easting: float = 0.0
    false_northing: float = 0.0
    ellipsoid: GeogCS | None = None
    grid_mapping_name = "vertical_perspective"


@dataclass(frozen=True)
class Geostationary(CoordSystem):
    latitude_of_projection_origin: float = 0.0
    longitude_of_projection_origin: float = 0.0
    perspective_point_height: float = 0.0
    sweep_angle_axis: str = "y"
    false_easting: float = 0.0
    false_northing: float = 0.0
    ellipsoid: GeogCS | None = None
    grid_mapping_name = "geostationary"

    def __post_init__(self):
        if self.latitude_of_projection_origin != 0 or self.sweep_angle_axis not in ("x", "y"):
            raise ValueError("a geostationary view is above the equator and sweeps along x or y")


@dataclass(frozen=True)
class Stereographic(CoordSystem):
    central_lat: float = 0.0
    central_lon: float = 0.0
    false_easting: float = 0.0
    false_northing: float = 0.0
    true_scale_lat: float | None = None
    ellipsoid: GeogCS | None = None
    scale_factor_at_projection_origin: float | None = None
    grid_mapping_name = "stereographic"

    def __post_init__(self):
        if self.true_scale_lat is not None and self.scale_factor_at_projection_origin is not None:
            raise ValueError("a latitude of true scale and a scale factor exclude each other")


@dataclass(frozen=True)
class PolarStereographic(Stereographic):
    grid_mapping_name = "polar_stereographic"


@dataclass(frozen=True)
class LambertConformal(CoordSystem):
    central_lat: float = 39.0
    central_lon: float = -96.0
    false_easting: float = 0.0
    false_northing: float = 0.0
    secant_latitudes: tuple[float, ...] = (33.0, 45.0)
    ellipsoid: GeogCS | None = None
    grid_mapping_name = "lambert_conformal_conic"


@dataclass(frozen=True)
class Mercator(CoordSystem):
    longitude_of_projection_origin: float = 0.0
    ellipsoid: GeogCS | None = None
    standard_parallel: float | None = None
    scale_factor_at_projection_origin: float | None = None
    false_easting: float = 0.0
    false_northing: float = 0.0
    grid_mapping_name = "mercator"


@dataclass(frozen=True)
class LambertAzimuthalEqualArea(CoordSystem):
    latitude_of_projection_origin: float = 0.0
    longitude_of_projection_origin: float = 0.0
    false_easting: float = 0.0
    false_northing: float = 0.0
    ellipsoid: GeogCS | None = None
    grid_mapping_name = "lambert_azimuthal_equal_area"


@dataclass(frozen=True)
class AlbersEqualArea(CoordSystem):
    latitude_of_projection_origin: float = 0.0
    longitude_of_central_meridian: float = 0.0
    false_easting: float = 0.0
    false_northing: float = 0.0
    standard_parallels: tuple[float, ...] = (20.0, 50.0)
    ellipsoid: GeogCS | None = None
    grid_mapping_name = "albers_conical_equal_area"


@dataclass(frozen=True)
class ObliqueMercator(CoordSystem):
    azimuth_of_central_line: float = 0.0
    latitude_of_projection_origin: float = 0.0
    longitude_of_projection_origin: float = 0.0
    false_easting: float = 0.0
    false_northing: float = 0.0
    scale_factor_at_projection_origin: float = 1.0
    ellipsoid: GeogCS | None = None
    grid_mapping_name = "oblique_mercator"


@dataclass(frozen=True)
class RotatedMercator(ObliqueMercator):
    azimuth_of_central_line: float = 90.0
    grid_mapping_name = "oblique_mercator"


SYSTEMS = {c.__name__: c for c in (GeogCS, RotatedGeogCS, TransverseMercator, Orthographic, VerticalPerspective, Geostationary, Stereographic, PolarStereographic, LambertConformal, Mercator, LambertAzimuthalEqualArea, AlbersEqualArea, ObliqueMercator, RotatedMercator)}


def to_dict(system: CoordSystem | None) -> dict | None:
    return None if system is None else {"class": type(system).__name__, "values": asdict(system)}


def from_dict(x: dict | None) -> CoordSystem | None:
    if x is None:
        return None
    values = dict(x["values"])
    if values.get("ellipsoid"):
        e = values["ellipsoid"]
        values["ellipsoid"] = GeogCS(e["semi_major_axis"], e["semi_minor_axis"], None, e["longitude_of_prime_meridian"])
    if x["class"] == "GeogCS":
        return GeogCS(values["semi_major_axis"], values["semi_minor_axis"], None, values["longitude_of_prime_meridian"])
    return SYSTEMS[x["class"]](**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})
