"""Registered queries, the tables they derive their input from, and their SQL statements."""
