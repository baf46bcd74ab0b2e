"""What changed between two versions of a table."""

from pyspark.sql import functions as F

from ledgerloom.operators.latest import row_hash
from ledgerloom.sources.tables import settled

INSERT, UPDATE, DELETE = "insert", "update", "delete"


def change_feed(old, new, key="id", settle=False):
    """The rows of `new` that are not as they were, and the rows of `old` that have gone, with `_change`:
    insert, update or delete.

    Both versions hold each key once, and the same columns; null keys are left out. Key and row hash are
    compared first, a narrow join of both versions; rows are then fetched for the changed keys only.
    With `settle` (as elsewhere) these are written, and few of them are looked up without moving rows.
    """
    columns = sorted(c for c in new.columns if c != key)

    def narrow(df, name):
        return df.filter(F.col(key).isNotNull()).select(key, row_hash(df.select(key, *columns)).alias(name))

    both = narrow(old, "_old").join(narrow(new, "_new"), key, "full")
    change = (
        F.when(F.col("_old").isNull(), INSERT)
        .when(F.col("_new").isNull(), DELETE)
        .when(F.col("_old") != F.col("_new"), UPDATE)
    )
    changed = both.select(key, change.alias("_change")).filter(F.col("_change").isNotNull())
    changed = settled(changed, settle, "changed-keys")
    gone = F.col("_change") == DELETE
    now = new.join(changed.filter(~gone), key).select(key, *columns, "_change")
    before = old.join(changed.filter(gone), key).select(key, *columns, "_change")
    return now.unionByName(before)
