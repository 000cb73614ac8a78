"""Operators bound to the driver's tables, with the SQL that each is held against."""
