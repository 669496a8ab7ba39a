"""Spark jobs for machine-wear analytics and text-corpus preparation."""
