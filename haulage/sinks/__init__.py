"""sinks of haulage."""
