"""Quillon: an auditable people-and-network analytics engine whose every step is a Spark plan."""
