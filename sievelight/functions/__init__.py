"""Column functions: text in, Column out, no DataFrame needed."""
