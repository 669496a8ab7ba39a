"""functions of the wear analytics library."""
