"""Whole analyses: variable selection, cross-validation and projection."""
