"""operators of haulage."""
