"""gridspark: labelled, multi-dimensional gridded data on Spark DataFrames."""

from .frame import Cell, CellMethod, Coord, Grid, GridError
from .operators.collection import GridList
from .operators.interpolate import Linear, Nearest
from .operators.regrid import AreaWeighted, PointInCell, UnstructuredNearest
from .operators.subset import AttributeConstraint, Constraint, NameConstraint, PartialDateTime

__all__ = ["AreaWeighted", "AttributeConstraint", "Cell", "CellMethod", "Constraint", "Coord", "Grid", "GridError", "GridList", "Linear", "NameConstraint", "Nearest", "PartialDateTime", "PointInCell", "UnstructuredNearest"]
