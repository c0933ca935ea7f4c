"""Sceneline: a PySpark-native engine for time-aligned film, text and corpus data."""
