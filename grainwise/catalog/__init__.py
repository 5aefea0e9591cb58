"""Runnable queries over the star-schema tables."""
