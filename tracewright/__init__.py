"""Audit-event provenance analytics expressed as Spark DataFrame operators."""
