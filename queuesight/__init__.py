"""Support-ticket analytics as Spark jobs: DataFrames in, DataFrames out."""
