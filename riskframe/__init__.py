"""Riskframe: dependency-risk analytics over a fleet of projects, as Spark jobs."""

__version__ = "0.1.0"
