"""That sides are measured before they are broadcast, and meshes dealt, in the queries that larger copies have shown to need it."""

import pytest

from terravox.operators import mesh, registration
from terravox.plans import adapters, registry


def static_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("crowd", [8, 512])
def test_cells_are_not_broadcast_by_guess(spark, sf_dir, monkeypatch, crowd):
    """Neither the 27 cells around each target nor the leaves of halved cells are broadcast by the size of their files."""
    monkeypatch.setattr(registration, "CROWD", crowd)
    assert "BroadcastHashJoin" not in static_plan(registry.QUERIES["nn_rmse"](spark, sf_dir))


def test_merged_corners_are_dealt(spark, sf_dir, monkeypatch):
    """The corners that a merge numbers come from parts that are dealt by mesh, and from no guessed broadcast."""
    monkeypatch.setattr(adapters, "MESHES_A_TASK", 30, raising=False)
    plans, scratch = [], mesh.scratch
    monkeypatch.setattr(mesh, "scratch", lambda df, label: plans.append(static_plan(df)) or scratch(df, label))
    assert registry.QUERIES["mesh_merge_world"](spark, sf_dir).count() > 0
    assert "REPARTITION_BY_NUM" in plans[0] and "BroadcastHashJoin" not in plans[0]
