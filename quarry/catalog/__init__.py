"""Importing this package registers every named query."""

from quarry.catalog import ledger  # noqa: F401
from quarry.catalog import warehouse  # noqa: F401
from quarry.catalog import cohorts  # noqa: F401
from quarry.catalog import tidy  # noqa: F401
from quarry.catalog import teams  # noqa: F401
from quarry.catalog import experiments  # noqa: F401
from quarry.catalog import analysis  # noqa: F401
from quarry.catalog import learning  # noqa: F401
from quarry.catalog import io  # noqa: F401

# Oracles that need definitions from more than one catalog module.
from quarry.catalog.warehouse import ORACLE_TOP15 as _TOP15  # noqa: E402
from quarry.plans.registry import ORACLE as _ORACLE  # noqa: E402

_ORACLE["f3_top15_teams_by_net_profit"] = _TOP15
