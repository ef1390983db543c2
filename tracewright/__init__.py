"""Spark-native curation and analysis of multi-turn agent trajectories."""
