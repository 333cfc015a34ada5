"""Relational operators over facts, packs, snapshots, trees, histories and metric samples."""
