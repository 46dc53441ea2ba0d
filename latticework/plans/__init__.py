"""Voxel plans."""
