"""Spark-native analytics over source code and text: detectors, facts, scoring and reports as DataFrame transformations."""
