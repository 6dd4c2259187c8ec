"""plans of haulage."""
