"""Typed loads."""
