"""Latticework: voxel-grid analytics as Spark DataFrame operators."""
