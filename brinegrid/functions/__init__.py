"""Column functions: geodesy, cell predicates and penalties, tags."""
