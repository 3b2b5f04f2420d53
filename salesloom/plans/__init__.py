"""Composed runs (the daily digest) and the registry of jobs over the test
tables with their SQL oracles."""
