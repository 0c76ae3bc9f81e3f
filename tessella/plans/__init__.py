"""Queries over the driver's tables: thin bindings of the operators, with oracle SQL."""
