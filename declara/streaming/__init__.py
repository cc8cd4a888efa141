"""Stream counterparts of the state operators."""
