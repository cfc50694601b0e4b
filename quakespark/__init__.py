"""Geodetic and seismological analytics over Spark tables."""
