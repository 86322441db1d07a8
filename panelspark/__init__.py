"""Statistical-panel analytics on PySpark."""
from panelspark.api import PanelData, open
from panelspark.panel import Panel
from panelspark.schema import DataQualityError, PanelLookupError

__all__ = ["DataQualityError", "Panel", "PanelData", "PanelLookupError", "open"]
