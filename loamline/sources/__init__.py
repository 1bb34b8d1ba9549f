"""Scanners of journals, trace logs and their companions."""
