"""operators of the wear analytics library."""
