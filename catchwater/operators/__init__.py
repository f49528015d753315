"""DataFrame operators over cell tables."""
