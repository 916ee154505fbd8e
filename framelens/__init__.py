"""Spark jobs for tables of episode frames that carry actions, validity flags and learned labels."""
