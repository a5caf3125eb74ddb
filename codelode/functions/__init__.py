"""Spark-native building blocks; see the modules of this package."""
