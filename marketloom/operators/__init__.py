"""DataFrame operators. Each is lazy, keyed, and splits any key that may be hot."""
