"""Table schemas, loading and staging."""

from quotelens.sources.layout import write_ranges
from quotelens.sources.schemas import SCHEMAS
from quotelens.sources.staging import Staging, shared_folder
from quotelens.sources.tables import load_tables, tables_from_catalog

__all__ = ["SCHEMAS", "Staging", "load_tables", "shared_folder", "tables_from_catalog", "write_ranges"]
