from . import geometry, scalar

__all__ = ["geometry", "scalar"]
