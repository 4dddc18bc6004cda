"""Queries over the driver's star schema."""
