"""Spark-native tables for antimicrobial-resistance surveillance."""
