"""The codec over unbounded frames: entropy states live in the state store."""
