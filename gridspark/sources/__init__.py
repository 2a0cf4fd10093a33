"""Sources and sinks; importing the package registers every format and writer."""

from . import dispersion, netcdf3, nimrod, pp, raster, store

__all__ = ["dispersion", "netcdf3", "nimrod", "pp", "raster", "store"]
