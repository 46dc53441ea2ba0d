"""Voxel operators."""
