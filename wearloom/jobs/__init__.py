"""jobs of the wear analytics library."""
