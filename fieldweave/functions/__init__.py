"""Functions of columns: units, predicates, physics."""
