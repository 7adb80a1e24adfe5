"""Every query of the library, by name, and the SQL it is checked against."""

from scrivenry.plans import audit, evaluation, jobs, metrics, pipelines, reading, sampling, terms  # noqa: F401
from scrivenry.plans.common import ORACLE_SQL, QUERIES  # noqa: F401
