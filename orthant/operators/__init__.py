"""Builders of partitions and what is done with them."""
