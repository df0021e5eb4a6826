"""Acceptance, settlement and training-data analytics as Spark jobs."""
