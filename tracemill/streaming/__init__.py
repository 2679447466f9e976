"""Detection on event streams."""
