"""Incremental intake and windowed reports."""
