"""Fracture-trace network analytics on Spark."""
