"""Column-expression builders: everything here returns ``Column`` objects, no jobs."""
