"""Spark-native spatial measurement engine."""

from __future__ import annotations

import os
from pathlib import Path


def ship(spark) -> None:
    """Lets Python workers import this package from where the driver has it, as on a shared or local path.

    A cluster without such a path gets the package by --py-files.
    """
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join(p for p in (root, *paths) if p)
