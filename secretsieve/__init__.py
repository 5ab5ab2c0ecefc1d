"""Leaked-secret analytics over issue reports, expressed as Spark DataFrame jobs."""
