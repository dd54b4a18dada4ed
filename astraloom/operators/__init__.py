"""Relational operators over code facts."""
