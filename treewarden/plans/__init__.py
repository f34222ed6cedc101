"""Whole runs, from files to findings."""
