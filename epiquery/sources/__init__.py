"""Readers and writers of the reference data: CSV label tables, label lists, JSON items, triples, sheets, artifacts."""
