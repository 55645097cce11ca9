"""Readers for the input files and writers for the results."""
