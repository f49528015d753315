"""Rain that arrives as a stream."""
