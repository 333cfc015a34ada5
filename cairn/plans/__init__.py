"""Typed queries, their canonical form, freshness, saved views; resumable jobs."""
