"""Queries as functions of frames."""
