"""sources of haulage."""
