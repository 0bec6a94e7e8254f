"""Descriptions of a partition, small enough for the driver."""
