"""Queries over the driver's tables and the SQL that must give the same rows."""
