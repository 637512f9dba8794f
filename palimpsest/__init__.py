"""Conversational-memory analytics and training-data operators on PySpark."""
