"""Compilation of checks into fused aggregates, and the roll-ups above them."""
