"""Snapshots and subscriptions."""
