"""Derived views over the test tables and the registered queries."""
