"""Plug-ins: modules that add formats, writers or operators when they are imported."""

from __future__ import annotations

import importlib
from importlib.metadata import entry_points
from types import ModuleType

#: Installed packages name their plug-ins in this group of entry points.
GROUP = "gridspark.plugins"


def use_plugin(name: str) -> ModuleType:
    """Import the plug-in that an installed package offers as ``name``, or the module ``gridspark_plugins.<name>``."""
    for found in entry_points(group=GROUP, name=name):
        return found.load()
    return importlib.import_module(f"gridspark_plugins.{name}")
