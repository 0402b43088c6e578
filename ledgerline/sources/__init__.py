"""Typed reads (S1-S8, G4) and the cell-table sink (K1)."""
