"""Spark-native analytics over ordered market and ledger data."""
