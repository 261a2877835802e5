"""Registered analyses: one callable plus an independent SQL check per query."""
