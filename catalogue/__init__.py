"""Registered queries: every operator bound to the star-schema tables."""

from . import chances, extraction, history, loading, quality, training

MODULES = (history, quality, chances, loading, extraction, training)
