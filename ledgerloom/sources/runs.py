"""Narrow tables by key that grow batch by batch, as sorted runs.

A run is a folder of Parquet files in the order of a hash of the key, written once. A manifest names
the runs that make up the table; a write adds a run by writing the next manifest. As many runs of a
level as `FAN` are merged into one of the next level, so every row is written again a logarithmic
number of times and a table has a logarithmic number of runs.

A look-up knows from the manifest which files can hold the hashes it asks for, opens only these, and in
them Parquet's page index leaves all pages but those of the hashes unread. What a look-up reads thus
grows with the keys asked for and the number of runs, not with the table.
"""

import json
import uuid
from bisect import bisect_left
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import shuffles_removed
from ledgerloom.sources.tables import COMPACT

FAN = 8
FILE_ROWS = 1 << 20
PAGE_ROWS = 1000
GROUP_BYTES = 8 << 20  # of a row group; its pages are found through one index
ASKED_AT_ONCE = 400  # hashes that one scan compares its pages with, one by one
MAX_ASKED = 64 * ASKED_AT_ONCE  # hashes that go through the driver; more are joined
KEPT_MANIFESTS = 16  # that readers may still use; older ones and their runs are removed
IN_FILTER = "spark.sql.parquet.pushdown.inFilterThreshold"


class Manifests:
    """Numbered states of a folder, each a list of entries in a JSON file that is written once.

    A state is replaced by writing the next number. Of two writers one gets the number, and the other
    starts again from what the first has written.
    """

    def __init__(self, spark, path):
        self.spark, self.path = spark, path
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _file(self, number):
        return self._path(f"{self.path}/manifests/{number}.json")

    def numbers(self):
        folder = self._path(f"{self.path}/manifests")
        if not self.files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.files.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def entries(self, number=None):
        """The entries of a state, by default the last one; none before the first."""
        if number is None:
            number = self.numbers()[-1:]
            number = number[0] if number else 0
        if number == 0:
            return []
        stream = self.files.open(self._file(number))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def commit(self, change):
        """Write the next state, made by `change` from the entries of the last one; returns its number."""
        while True:
            numbers = self.numbers()
            last = numbers[-1] if numbers else 0
            entries = change(self.entries(last))
            claim = self._path(f"{self.path}/manifests/{last + 1}.claim-{uuid.uuid4().hex}")
            stream = self.files.create(claim, False)
            stream.write(bytearray(json.dumps(entries).encode()))
            stream.close()
            if last + 1 not in self.numbers() and self.files.rename(claim, self._file(last + 1)):
                self._forget([*numbers, last + 1])
                return last + 1
            self.files.delete(claim, False)

    def _forget(self, numbers):
        """Remove old states, and the folders that only they name."""
        old, kept = numbers[:-KEPT_MANIFESTS], numbers[-KEPT_MANIFESTS:]
        if old:
            folders = lambda states: {e.get("folder") for n in states for e in self.entries(n)}
            for folder in folders(old) - folders(kept) - {None}:
                self.files.delete(self._path(f"{self.path}/{folder}"), True)
            for number in old:
                self.files.delete(self._file(number), False)


class RunTable:
    """A table of rows with a hash column, below `path`.

    `schema` is in DDL and holds `hash_column`, a long. `combine` takes the rows of several runs to
    fewer rows that mean the same, such as sums by key; it must not depend on how rows lie in runs.
    `state` opens the table as it was after a commit of that number.
    """

    def __init__(self, spark, path, schema, hash_column, combine=None, state=None):
        self.spark, self.path, self.schema = spark, path, schema
        self.hash, self.combine = hash_column, combine or (lambda rows: rows)
        self.manifests, self.state = Manifests(spark, path), state

    def runs(self):
        """The runs of the table: folder, writer, number, level, rows and files, of which each has its
        name, least and largest hash and length in bytes."""
        return self.manifests.entries(self.state)

    def last(self):
        """The number of the last commit, 0 before the first."""
        return self.manifests.numbers()[-1] if self.manifests.numbers() else 0

    # Writing ------------------------------------------------------------------------------------------

    def _write(self, rows, writer, number, level, ranged=False):
        """Write a run that no manifest names yet; returns its entry."""
        folder = f"runs/{uuid.uuid4().hex}"
        target = f"{self.path}/{folder}"
        names = [f.name for f in self._empty().schema.fields]
        rows = rows.select(*names) if ranged else rows.select(*names).repartitionByRange(self.hash)
        sorted_rows = rows.sortWithinPartitions(self.hash)
        options = {
            "maxRecordsPerFile": FILE_ROWS, "parquet.page.row.count.limit": PAGE_ROWS,
            "parquet.block.size": GROUP_BYTES, "compression": COMPACT,
        }
        with shuffles_removed(self.spark):
            sorted_rows.write.options(**options).parquet(target)
        meta = F.col("_metadata")
        written = self.spark.read.schema(self.schema).parquet(target)
        found = written.groupBy(meta["file_name"].alias("name"), meta["file_size"].alias("bytes")).agg(
            F.min(self.hash).alias("low"), F.max(self.hash).alias("high"), F.count(F.lit(1)).alias("rows")
        )
        # One row a file of up to `FILE_ROWS` rows.
        files = [r.asDict() for r in found.collect()]
        n = sum(f.pop("rows") for f in files)
        entry = {"folder": folder, "writer": writer, "number": number, "level": level, "rows": n}
        return entry | {"files": sorted(files, key=lambda f: f["low"])}

    def put(self, rows, writer, number, ranged=False):
        """Add a writer's rows under a number, in place of those it gave under the same number before;
        then merge runs where there are enough. Writers count up, and only their last number may come
        again: that run is not merged. `ranged` rows lie in partitions by ranges of the hash already and
        stay there. Returns the rows as they were stored."""
        entry = self._write(rows, writer, number, 0, ranged)

        def change(runs):
            return [r for r in runs if (r["writer"], r["number"]) != (writer, number)] + [entry]

        self.manifests.commit(change)
        self._merge()
        return self._of([entry])

    def _full_level(self):
        runs = self.runs()
        last = {}
        for run in runs:
            if run["writer"] is not None:
                last[run["writer"]] = max(run["number"], last.get(run["writer"], run["number"]))
        levels = {}
        for run in runs:
            if run["writer"] is None or run["number"] < last[run["writer"]]:
                levels.setdefault(run["level"], []).append(run)
        full = [level for level, found in sorted(levels.items()) if len(found) >= FAN]
        return levels[full[0]] if full else None

    def _merge(self):
        while merging := self._full_level():
            rows = self.combine(self._of(merging))
            entry = self._write(rows, None, None, merging[0]["level"] + 1)
            gone = {r["folder"] for r in merging}

            def change(runs):
                if not gone <= {r["folder"] for r in runs}:  # another writer has merged them
                    return runs
                return [r for r in runs if r["folder"] not in gone] + [entry]

            self.manifests.commit(change)

    # Reading ------------------------------------------------------------------------------------------

    def _empty(self):
        return self.spark.createDataFrame([], self.schema)

    def _of(self, runs, names=None):
        paths = [
            f"{self.path}/{r['folder']}/{f['name']}"
            for r in runs
            for f in r["files"]
            if names is None or (r["folder"], f["name"]) in names
        ]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self._empty()

    def _but(self, without):
        return [r for r in self.runs() if (r["writer"], r["number"]) != without]

    def rows(self, without=None):
        """All rows, but for those of one writer's number."""
        return self._of(self._but(without))

    def find(self, asked: DataFrame, without=None):
        """The rows whose hash is in the column of that name of `asked`, but for those of one writer's
        number. Rows of other keys with the same hash are among them.

        Up to `MAX_ASKED` hashes go through the driver, and each `ASKED_AT_ONCE` of them, which are next
        to each other in every run, make one scan. With more, and where the hashes' pages could make up
        the table, it is read whole and joined.
        """
        runs = self._but(without)
        few = asked.select(self.hash).dropna().distinct().limit(MAX_ASKED + 1).collect() if runs else []
        if len(few) > MAX_ASKED or sum(r["rows"] for r in runs) <= PAGE_ROWS * len(few):
            return self._of(runs).join(asked.select(self.hash).distinct(), self.hash, "left_semi")
        hashes = sorted(r[0] for r in few)
        # Up to this many values the scan compares pages with each value, beyond it with their range.
        if int(self.spark.conf.get(IN_FILTER)) < ASKED_AT_ONCE:
            self.spark.conf.set(IN_FILTER, str(ASKED_AT_ONCE))
        parts = [
            self._of(runs, names).filter(F.col(self.hash).isin(some))
            for some in (hashes[i : i + ASKED_AT_ONCE] for i in range(0, len(hashes), ASKED_AT_ONCE))
            if (names := _files_with(runs, some))
        ]
        return reduce(DataFrame.unionAll, parts) if parts else self._empty()


def _files_with(runs, hashes):
    """The files that can hold some of the sorted hashes."""
    return {
        (r["folder"], f["name"])
        for r in runs
        for f in r["files"]
        if bisect_left(hashes, f["low"]) < bisect_left(hashes, f["high"] + 1)
    }
