"""Gleaner: scoring, selection, retrieval and graph analytics as Spark plans."""

__version__ = "0.1.0"
