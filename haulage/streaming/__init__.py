"""streaming of haulage."""
