"""Whole plans: diff, patch and cycle."""
