"""Connected components of a link table: the library's own (see operators/components.py)."""

from __future__ import annotations

from ..operators.components import connected_components, forest

__all__ = ["connected_components", "forest"]
