"""Readers of agents' logs and of stored turns."""
