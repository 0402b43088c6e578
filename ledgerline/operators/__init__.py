"""Operators over DataFrames: joins, bands, cross-tabs, horizontal bands, blocks, drill-through."""
