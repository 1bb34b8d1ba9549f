"""Joins, storage and comparison of journal and trace rows."""
