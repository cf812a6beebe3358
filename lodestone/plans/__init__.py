"""Helpers that shape physical plans: written intermediate tables and session settings."""
