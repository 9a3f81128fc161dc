"""Readers and writers of the interval formats."""
