"""The batch job: invoice store to landing, bronze, silver and the four gold tables."""

from ledgerloom.operators.gold import GOLD_TABLES
from ledgerloom.operators.medallion import bronze, silver, with_audit_columns
from ledgerloom.sources.tables import read_table, scratch, write_table, zone_path


def run_medallion(spark, invoices, base, fmt="parquet", from_files=True):
    """Rebuild every zone below `base` from the invoice records; turn `from_files` off when these
    are not a plain file scan.

    Returns path and row count of every table. Each zone is written once and read back by the next
    one, so a lost executor costs at most the running stage's work and the gold tables read only the
    silver columns they use. Unless very many ids are repeated or there are very many vendors no zone moves
    whole rows. What the steps write beside the zones is removed.
    """
    done = {}

    def store(zone, name, df):
        path = zone_path(base, zone, name)
        done[name] = (path, write_table(df, path, fmt))
        return read_table(spark, path, fmt)

    raw = store("landing", "raw_invoices", with_audit_columns(invoices, from_files))
    with scratch(spark) as keep:
        clean = store("bronze", "invoices_bronze", bronze(raw, settle=keep))
        enriched = store("silver", "invoices_silver", silver(clean, settle=keep))
    for name, build in GOLD_TABLES.items():
        store("gold", name, build(enriched))
    return done
