"""Voxel functions."""
