"""Profiling, imputation, report, and run-history operators."""
