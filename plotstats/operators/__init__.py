"""Survey statistics operators (all ``DataFrame -> DataFrame``)."""
