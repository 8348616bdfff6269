"""Checked, all-or-nothing load of dimension tables (S2 + S3 + S4 + S5).

``load_dimensions`` takes the files of a load through these steps, each
table on its own, so that a table that is rejected does not hold up the others:

1. S2: columns by position, cast to the table's types. A text that does not
   cast is a fault of its row (``bad_text``), not a null;
2. S5: NOT NULL columns, then the table's CHECK rules;
3. ``strict``: one faulty row rejects the whole load of the table, and what was
   stored before stays. ``quarantine``: faulty rows are written beside the
   table with their faults, the others are loaded;
4. S4: of rows with the same key, the first in file order is kept;
5. the rows are written to a folder of their own, and a one-row manifest file
   then names that folder. Readers follow the newest manifest, so they see the
   whole load or nothing of it; a load that dies earlier leaves no trace in them,
   and a load repeated under its number replaces its own folder.

One writer a table at a time. File order is (file name, start of the split,
row within the split), whatever the number of splits and tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as SC
from ..operators.quality import dedupe_keep_first
from .files import missing_source_default, path_exists

POSITION = ["_file", "_start", "_row"]
MANIFEST = "table_name string, load_id long, path string, stored_rows long"
REPORT = ("table_name string, load_id long, row_count long, bad_text long, null_values long, rule_violations long, "
          "bad_rows long, duplicate_rows long, stored_rows long, committed boolean")


def typed(text: Column, kind: T.DataType) -> Column:
    """``text`` as ``kind``, null where it does not cast; boolean text counts 1 or 0 in a double column."""
    if isinstance(kind, T.DoubleType):
        return F.coalesce(text.try_cast("double"), text.try_cast("boolean").cast("double"))
    return text.try_cast(kind)


def read_checked(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Rows of a dimension file by position, typed, with their place in the file and ``_faults``.

    ``_faults`` lists ``text:<column>`` (does not cast), ``null:<column>`` and
    ``rule:<number>``. A rule whose result is null passes, as a SQL CHECK does.
    A file with fewer columns than the table has nulls in the missing ones.
    """
    schema, _, rules = SC.DIMENSIONS[name]
    raw = spark.read.option("header", True).csv(path)
    given = raw.columns[: len(schema.fields)]
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
             F.monotonically_increasing_id().alias("_row")]
    texts = raw.select(*[F.col(f"`{c}`").alias(f"_t{i}") for i, c in enumerate(given)], *place)
    rows = texts.select("*", *[(typed(F.col(f"_t{i}"), f.dataType) if i < len(given) else F.lit(None).cast(f.dataType)).alias(f.name)
                               for i, f in enumerate(schema.fields)])
    faults = [F.when(F.col(f"_t{i}").isNotNull() & F.col(f.name).isNull(), F.lit(f"text:{f.name}"))
              for i, f in enumerate(schema.fields) if i < len(given)]
    faults += [F.when((F.col(f"_t{i}") if i < len(given) else F.lit(None)).isNull(), F.lit(f"null:{f.name}"))
               for i, f in enumerate(schema.fields) if not f.nullable]
    faults += [F.when(~F.coalesce(F.expr(r), F.lit(True)), F.lit(f"rule:{i}")) for i, r in enumerate(rules)]
    listed = F.array_except(F.array(*faults), F.array(F.lit(None).cast("string")))
    return rows.select(*schema.names, *POSITION, listed.alias("_faults"))


def _having(kind: str) -> Column:
    return F.exists("_faults", lambda f: f.startswith(kind))


def committed(spark: SparkSession, root: str, name: str) -> tuple[int, str | None]:
    """(number, folder) of the newest committed load of a table; (0, None) before the first."""
    path = f"{root}/_manifest/{name}"
    if not path_exists(spark, path):
        return 0, None
    row = spark.read.schema(MANIFEST).json(path).orderBy(F.desc("load_id")).first()
    return (row.load_id, row.path) if row else (0, None)


def read_dimension(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table as last committed; empty and typed before the first load (S3)."""
    path = committed(spark, root, name)[1]
    if path is None:
        return missing_source_default(spark, name)
    return spark.read.schema(SC.DIMENSIONS[name][0]).parquet(f"{root}/{path}")


def load_dimension_checked(spark: SparkSession, name: str, path: str, root: str, mode: str = "strict") -> dict:
    """Load one table into ``root``; what it found, as a row of ``REPORT``. A missing file leaves the table as it is."""
    if mode not in ("strict", "quarantine"):
        raise ValueError(f"mode must be strict or quarantine, not {mode!r}")
    schema, keys, _ = SC.DIMENSIONS[name]
    load_id = committed(spark, root, name)[0] + 1
    none = dict(table_name=name, load_id=load_id, row_count=0, bad_text=0, null_values=0, rule_violations=0,
                bad_rows=0, duplicate_rows=0, stored_rows=0, committed=False)
    if not path_exists(spark, path):
        return none
    folder = f"{name}/load={load_id:08d}"
    staged = f"{root}/_staging/{folder}"
    # the text is parsed and checked once; what follows reads this copy
    read_checked(spark, name, path).write.mode("overwrite").parquet(staged)
    rows = spark.read.parquet(staged)
    found = rows.agg(F.count(F.lit(1)).alias("row_count"), F.count_if(_having("text:")).alias("bad_text"),
                     F.count_if(_having("null:")).alias("null_values"), F.count_if(_having("rule:")).alias("rule_violations"),
                     F.count_if(F.size("_faults") > 0).alias("bad_rows")).first().asDict()
    report = none | found
    if mode == "strict" and report["bad_rows"]:
        return report
    if report["bad_rows"]:
        (rows.where(F.size("_faults") > 0).withColumnRenamed("_faults", "faults")
         .write.mode("overwrite").parquet(f"{root}/_quarantine/{folder}"))
    good = rows.where(F.size("_faults") == 0).select(*schema.names, *POSITION)
    dedupe_keep_first(good, keys, POSITION).select(*schema.names).write.mode("overwrite").parquet(f"{root}/{folder}")
    stored = spark.read.parquet(f"{root}/{folder}").count()
    # one row is one file, and a file appears whole
    (spark.createDataFrame([(name, load_id, folder, stored)], MANIFEST).coalesce(1)
     .write.mode("append").json(f"{root}/_manifest/{name}"))
    return report | dict(stored_rows=stored, duplicate_rows=report["row_count"] - report["bad_rows"] - stored, committed=True)


def load_dimensions(spark: SparkSession, files: dict[str, str], root: str, mode: str = "strict") -> DataFrame:
    """Load ``files`` (table -> CSV path) into ``root``; one report row a table, in the order of ``files``.

    Every table is loaded whatever became of the others. At most one row for
    each kind of dimension table passes through the driver.
    """
    found = [load_dimension_checked(spark, name, path, root, mode) for name, path in files.items()]
    names = [f.split()[0] for f in REPORT.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in found], REPORT)
