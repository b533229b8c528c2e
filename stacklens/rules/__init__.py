from stacklens.rules import fixed

__all__ = ["fixed"]
