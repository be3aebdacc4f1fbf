"""All queries of the core."""

from __future__ import annotations

from . import files, timeline

QUERIES = {**timeline.QUERIES, **files.QUERIES}
SQL = {**timeline.SQL, **files.SQL}
