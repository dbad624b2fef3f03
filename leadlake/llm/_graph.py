"""Cutting lineage and connected components, as the rest of the library has them."""

from leadlake.operators.graph import connected_components, durable, shared_folder

__all__ = ["connected_components", "durable", "shared_folder"]
