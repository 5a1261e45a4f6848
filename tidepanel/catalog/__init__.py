"""Registered queries: each operator bound to the test tables, with its SQL counterpart."""
