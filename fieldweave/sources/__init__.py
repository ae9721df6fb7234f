"""Reading, writing and normalising fields and observations."""
