"""Continuous-profiling analytics expressed as Spark DataFrame jobs."""
