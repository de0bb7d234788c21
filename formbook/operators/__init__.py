"""Generic relational operators: column names are parameters."""
