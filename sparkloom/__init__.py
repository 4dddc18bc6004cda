"""Sparkloom: analytics and data preparation as plain Spark jobs."""
