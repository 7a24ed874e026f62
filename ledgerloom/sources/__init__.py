"""Inputs, dimensions and the versioned store."""
