"""Column expressions: cell tests, parsers, masks and the fixed patterns they use."""
