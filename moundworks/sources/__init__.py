"""Readers of the raw relations and writers of results."""
