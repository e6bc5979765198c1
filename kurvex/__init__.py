"""Spark-native analytics of repeated planar and scalar trajectories."""
