"""Relational, statistical, geometric and quality operators over DataFrames."""
