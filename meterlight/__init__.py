"""Meterlight: Spark-native analytics over LLM usage events (tokens, cost, impact, billing)."""
