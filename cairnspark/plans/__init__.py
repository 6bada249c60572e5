"""The query catalogue: named plans over the test tables, with the SQL that must give the same rows."""

from . import protocol as _protocol  # registers its plans
from .catalogue import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
