"""Operators put together into whole analyses."""
