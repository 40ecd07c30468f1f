"""Composed jobs over the operators: catalogue, ingest and clean, governance mart, measures, reports."""
