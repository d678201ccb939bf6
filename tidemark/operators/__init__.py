"""Operators over DataFrames: ordered access, version logs, lots, bands and certification."""
