"""The subpackage's queries and their SQL, for the entry module."""

from . import clusters, decontamination, infill, licenses, lines, machine, mixing, pii, quality, secrets, simhash, tokens, toxicity
from .common import query_registry

QUERIES, ORACLE_SQL = query_registry(decontamination, quality, secrets, licenses, mixing, simhash, pii, toxicity, lines, tokens, machine, infill, clusters)
