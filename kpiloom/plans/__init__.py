from kpiloom.plans.dashboard import build_dashboard, dashboard_tables, snapshot_tables, stored_kpi_cards
from kpiloom.plans.export import export_bundle, export_detail, preview, ranking_bundle, write_report
from kpiloom.plans.load import load_to_database, load_to_snapshot

__all__ = [
    "build_dashboard",
    "dashboard_tables",
    "snapshot_tables",
    "stored_kpi_cards",
    "export_bundle",
    "export_detail",
    "load_to_database",
    "load_to_snapshot",
    "preview",
    "ranking_bundle",
    "write_report",
]
