"""Queries without an oracle run over the whole volume."""

from lattiq.operators import geometry
from lattiq.plans.base import vox
from lattiq.plans.registry import QUERIES
from tests.test_parity import SF


def test_iso_surface_covers_the_volume(spark):
    v, n = vox(spark, SF)
    assert QUERIES["iso_surface"](spark, SF).count() == geometry.welded(geometry.iso_triangles(v.select("z", "y", "x", "v"), n, 25.0))[1].count()
