"""Catalogue, placement, dialect and plan descriptions."""
