"""All registered queries of the library and the SQL that states their results."""

from __future__ import annotations

from .queries import corpus, files, groups, models

QUERIES: dict = {**corpus.QUERIES, **models.QUERIES, **groups.QUERIES, **files.QUERIES}
SQL: dict[str, str] = {**corpus.SQL, **models.SQL, **groups.SQL, **files.SQL}
