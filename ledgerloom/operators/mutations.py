"""Keyed changes to the invoice table: upsert, partial update, delete, failure records."""

from functools import reduce

from pyspark.sql import functions as F

from ledgerloom.operators.latest import first_per_key, row_hash
from ledgerloom.operators.lookup import GROUP, join_keyed, join_values, keyed
from ledgerloom.sources.tables import settled

KEYS = ["user_id", "id"]

# Columns no update may touch, and the ones the page may change.
PROTECTED = ["id", "user_id", "blob_path", "correlation_id"]
EDITABLE = ["notes", "tags", "spend_category", "subcategory"]


def _aligned(df, fields):
    """The columns of `fields`, null where the rows lack one."""
    return df.select(
        *[
            F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in fields
        ]
    )


def upsert_latest(stored, incoming, keys=("id", "user_id"), sequence="processed_at", settle=False):
    """Merge incoming rows into a table; of each key they name one row stays, the later by `sequence`.

    At equal sequence the incoming row wins; rows that tie are told apart by a hash. Stored rows of
    other keys are left as they are. With `settle` the incoming rows are written first and the joins
    are planned from their real size: a small batch is broadcast and the stored rows stay where they
    are, but for those of the keys named.
    """
    fields = [*stored.schema, *[f for f in incoming.schema if f.name not in stored.columns]]
    stored, incoming = _aligned(stored, fields), _aligned(incoming, fields)
    order = [F.col(sequence).desc_nulls_last(), row_hash(incoming)]
    newest = first_per_key(incoming, list(keys), order)
    new = keyed(newest, F.struct(*keys)).select(*GROUP, F.struct(*stored.columns).alias("_new"))
    new = settled(new, settle, "incoming")

    listed = new.select(*GROUP)
    named = join_values(stored, F.struct(*keys), listed, "left_semi")
    order = [F.col(sequence).desc_nulls_last(), row_hash(stored)]
    current = keyed(first_per_key(named, list(keys), order), F.struct(*keys))
    current = current.select(*GROUP, F.struct(*stored.columns).alias("_old"))
    old, fresh = F.col("_old")[sequence], F.col("_new")[sequence]
    stays = F.col("_old").isNotNull() & old.isNotNull() & (fresh.isNull() | (fresh < old))
    merged = join_keyed(new, current).select(
        F.when(stays, F.col("_old")).otherwise(F.col("_new")).alias("_row")
    )
    others = join_values(stored, F.struct(*keys), listed, "left_anti")
    return others.unionByName(merged.select("_row.*"))


def changes_per_key(changes, columns, sequence):
    """Fold several changes to one invoice into one: the last given value of each column.

    A column counts as given when it is named in the change's `fields` array, or, without such an
    array, when it is not null. The result holds `<column>` and `<column>_given`.
    """
    if "fields" in changes.columns:
        given = {c: F.array_contains("fields", c) for c in columns}
    else:
        given = {c: F.col(c).isNotNull() for c in columns}
    given = {c: F.coalesce(g, F.lit(False)) for c, g in given.items()}
    folded = []
    for c in columns:
        at = F.col(sequence) if sequence else F.lit(0)
        newest = F.struct(given[c].alias("given"), at.alias("at"), F.xxhash64(c).alias("tie"))
        folded += [
            F.max_by(F.struct(c), newest).alias(f"_{c}"),
            F.max(given[c]).alias(f"_{c}_given"),
        ]
    return keyed(changes, F.struct(*KEYS)).groupBy(*GROUP).agg(*folded)


def apply_updates(stored, changes, columns=None, sequence=None, settle=False):
    """Merge changes into the invoices they name; changes to unknown invoices have no effect.

    Without `columns` every column the changes carry is taken, except the protected ones. A change
    set without a single usable column is an error. `settle` writes the changes first, as in
    `upsert_latest`.
    """
    offered = [c for c in changes.columns if c not in [*PROTECTED, "fields", sequence]]
    columns = offered if columns is None else [c for c in columns if c in offered]
    unknown = [c for c in columns if c not in stored.columns]
    if not columns or unknown:
        raise ValueError(f"no fields to update, or unknown ones: {unknown}")
    # Only changes that carry something take part.
    if "fields" not in changes.columns:
        changes = changes.filter(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns]))
    folded = settled(changes_per_key(changes, columns, sequence), settle, "changes")
    changed = {
        c: F.when(F.coalesce(f"_{c}_given", F.lit(False)), F.col(f"_{c}.{c}")).otherwise(F.col(c))
        for c in columns
    }
    merged = join_values(stored, F.struct(*KEYS), folded).withColumns(changed)
    return merged.select(stored.columns)


def apply_page_edits(stored, edits, sequence=None, settle=False):
    """Updates as the detail page sends them: four editable columns, null means not given."""
    given = [c for c in edits.columns if c != "fields"]
    return apply_updates(stored, edits.select(given), EDITABLE, sequence, settle)


def apply_deletes(stored, keys, settle=False):
    """Invoices without those whose user and id are listed (`settle` as in `upsert_latest`)."""
    listed = keyed(keys, F.struct(*KEYS)).select(*GROUP).distinct()
    listed = settled(listed, settle, "deletes")
    return join_values(stored, F.struct(*KEYS), listed, "left_anti")


def failure_records(messages, invoice_id, processed_at):
    """The reduced record kept for a message that could not be processed."""
    return messages.select(
        invoice_id.alias("id"),
        "user_id",
        "source",
        "blob_path",
        F.lit("failed").alias("status"),
        "correlation_id",
        processed_at.alias("processed_at"),
    )
