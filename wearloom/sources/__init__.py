"""sources of the wear analytics library."""
