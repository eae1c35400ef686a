"""Event analytics over detection, track, signal and label tables on Spark."""
