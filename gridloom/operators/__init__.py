"""Array operators as relational plans."""
