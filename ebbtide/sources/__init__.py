"""Readers, writers and the mapping of raw tables onto analytic roles."""
