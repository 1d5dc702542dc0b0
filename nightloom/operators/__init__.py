"""DataFrame operators of the sky part."""
