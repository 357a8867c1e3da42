"""Media-catalog and timeline-integrity operators for Spark DataFrames."""
