"""Puts the repository root on the path, wherever pytest is started."""
