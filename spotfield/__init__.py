"""Spatial signaling analytics on Spark DataFrames.

The names below are loaded when they are first used, so that a task imports
only what it needs.
"""

from importlib import import_module

_MODULES = ("association", "contact", "evidence", "geometry", "histology", "mesh", "molecular", "projection", "ranges", "transport")
_NAMES = {
    "prepare_histology": ("operators.histology", "tissue"),
    "build_geometry": ("operators.geometry", "orientation_field"),
    "build_mesh": ("operators.mesh", "build"),
    "master_range_grid": ("functions.scalar", "master_ranges"),
    "trusted_range_grid": ("functions.scalar", "trusted_ranges"),
}
__all__ = [*_MODULES, *_NAMES]


def __getattr__(name):
    if name in _MODULES:
        return import_module(f".operators.{name}", __name__)
    if name in _NAMES:
        module, member = _NAMES[name]
        return getattr(import_module(f".{module}", __name__), member)
    raise AttributeError(name)
