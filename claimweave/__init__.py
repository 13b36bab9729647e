"""Claimweave: a PySpark-native analytics engine over a citable claims graph."""
