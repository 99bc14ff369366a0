"""Named queries over the tables, each with the SQL that gives the same rows where SQL can."""

from . import analysis, project, search, store, streams  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
