"""Voxel sources."""
