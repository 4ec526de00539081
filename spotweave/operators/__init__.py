"""Operators on the long tables of ``spotweave.tables``."""
