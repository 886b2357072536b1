"""User-behaviour risk analytics as Spark DataFrame jobs."""
