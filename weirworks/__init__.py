"""LLM delegation analytics as Spark DataFrame operators."""
