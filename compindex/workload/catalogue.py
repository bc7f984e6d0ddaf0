"""Imports every query module, which fills the registry."""

from compindex.workload import core, landed, matching, publication, risk, spatial, statistics, uncertain, units  # noqa: F401
from compindex.workload.registry import ORACLES, QUERIES  # noqa: F401
