"""Satellite-coverage analytics on Spark."""
