from orderlens.plans import analyses

__all__ = ["analyses"]
