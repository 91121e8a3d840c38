"""assayer: triage of static-analysis findings as Spark DataFrame jobs.

Findings, event traces and source code are tables; every operator takes and
returns DataFrames (or Columns), so Catalyst sees one plan from scan to sink.
"""

from assayer.session import local_session, scratch_dir

__all__ = ["local_session", "scratch_dir"]
