"""quarry: automated tabular analytics as composable Spark DataFrame operators.

Sub-packages
------------
sources    table loaders, delimited readers, sinks and result store
functions  column-expression helpers (text folding, null tokens, moments, p-values)
operators  DataFrame -> DataFrame operators (profile, clean, relate, forge, segment, ...)
plans      composed analyses and the derived fixture views used by tests
streaming  Structured Streaming jobs (file-arrival ingest, run status)
"""

from quarry.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
