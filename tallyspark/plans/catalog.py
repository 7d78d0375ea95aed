"""Imports every query module so that the registry is complete."""

from . import q_core, q_diff, q_docs, q_ingest, q_ledger, q_reconcile, q_sets, q_stream, q_summary  # noqa: F401
