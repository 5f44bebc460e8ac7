"""Spark-native reconciliation of financial ledgers."""
