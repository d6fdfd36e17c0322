"""Arrays that grow from streams."""
