"""Operators for cleaning the records and texts of a large corpus. Nothing else in the package imports this one."""
