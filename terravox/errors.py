"""Typed errors. `case` names the fault."""

from __future__ import annotations


class SpatialError(Exception):
    def __init__(self, case: str):
        super().__init__(case)
        self.case = case


class GeometryError(SpatialError):
    pass


class MeshError(SpatialError):
    pass


class VolumeError(SpatialError):
    pass


class StratigraphyError(SpatialError):
    pass


class SegmentationError(SpatialError):
    pass


class GeoError(SpatialError):
    pass


class RegistrationError(SpatialError):
    pass


class CustodyError(SpatialError):
    pass


class StoreError(SpatialError):
    pass


class ExportError(SpatialError):
    pass
