"""Source tables, and their views as canonical streams."""
