"""Following growing files."""
