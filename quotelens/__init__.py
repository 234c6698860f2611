"""quotelens: versioned pricing and policy tables into one modelling-ready table, on Spark."""

from quotelens.plans.assemble import build_mart, write_mart
from quotelens.plans.params import MartParams
from quotelens.sources.contracts import Contracts
from quotelens.sources.tables import load_tables, tables_from_catalog

__all__ = ["Contracts", "MartParams", "build_mart", "load_tables", "tables_from_catalog", "write_mart"]
