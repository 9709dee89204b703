"""Registered queries of the log-diagnosis engine."""
