"""Operators over points, voxels, patches and maps."""
