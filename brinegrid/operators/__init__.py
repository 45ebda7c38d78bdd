"""Operators over tables of cells, lines, corridors, searches and polylines."""
