"""Document-structure analytics on Spark."""

from quire.config import ConversionConfig, MobileProfile

__all__ = ["ConversionConfig", "MobileProfile"]
