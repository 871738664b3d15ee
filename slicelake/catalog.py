"""Every query of the library with its SQL, by name."""

from __future__ import annotations

import slicelake.plans.deid
import slicelake.plans.features
import slicelake.plans.inventory
import slicelake.plans.ledger
import slicelake.plans.relations
import slicelake.plans.scalars
import slicelake.plans.voxels  # noqa: F401
from slicelake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
