"""Registered queries over the test tables and their plain-SQL counterparts."""
