"""streaming of the wear analytics library."""
