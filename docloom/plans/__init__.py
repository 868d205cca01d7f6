"""Whole dataflows: search, comparison, ingest, and the tools on top of them."""
