"""Readers, samplers, splits and sinks."""
