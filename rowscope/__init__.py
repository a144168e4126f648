"""Explore, profile and compare structured data with Spark."""
