"""Temporal session analytics on Spark."""
