"""Registered queries: importing the package registers them all."""

from . import catalog, more, stores  # noqa: F401
