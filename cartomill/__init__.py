"""Spark-first analytics for versioned boundary data, gazetteers and text."""
