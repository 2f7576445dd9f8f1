"""Work-order KPIs as DataFrame-to-DataFrame functions on Spark."""

from kpiloom.config import DB, V1, WORKBOOK, KpiFilter, Profile

__all__ = ["DB", "V1", "WORKBOOK", "KpiFilter", "Profile"]
