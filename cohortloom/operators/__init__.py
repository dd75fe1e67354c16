"""Relational and data-quality operators; every one maps DataFrames to DataFrames lazily."""
