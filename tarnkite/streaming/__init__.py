"""Stateful operators over streams."""
