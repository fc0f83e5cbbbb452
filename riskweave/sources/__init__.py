"""Reading and writing tables, state and messages."""
