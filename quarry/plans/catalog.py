"""Imports every query module so the registry in ``common`` is complete."""

from quarry.plans import common
from quarry.plans import profile_queries  # noqa: F401
from quarry.plans import relate_queries  # noqa: F401
from quarry.plans import clean_queries  # noqa: F401
from quarry.plans import forge_queries  # noqa: F401
from quarry.plans import segment_queries  # noqa: F401
from quarry.plans import model_queries  # noqa: F401
from quarry.plans import survey_queries  # noqa: F401
from quarry.plans import insight_queries  # noqa: F401

QUERIES = common.QUERIES
ORACLE = common.ORACLE
