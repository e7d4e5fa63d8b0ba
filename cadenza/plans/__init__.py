"""Experiment plans: loading, running and reporting."""
