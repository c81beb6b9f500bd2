"""Table sources and the result sink.

CSV is read with a declared schema by default: inference costs one extra
pass over every file and turns zip prefixes such as ``01001`` into integers.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

_S, _I, _D, _TS = T.StringType(), T.IntegerType(), T.DoubleType(), T.TimestampNTZType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


# Column layout of the marketplace order tables (lower snake case names).
SCHEMAS: dict[str, T.StructType] = {
    "customers": _schema(("customer_id", _S), ("customer_unique_id", _S),
                         ("customer_zip_code_prefix", _S), ("customer_city", _S), ("customer_state", _S)),
    "order_items": _schema(("order_id", _S), ("order_item_id", _I), ("product_id", _S), ("seller_id", _S),
                           ("shipping_limit_date", _TS), ("price", _D), ("freight_value", _D)),
    "payments": _schema(("order_id", _S), ("payment_sequential", _I), ("payment_type", _S),
                        ("payment_installments", _I), ("payment_value", _D)),
    "orders": _schema(("order_id", _S), ("customer_id", _S), ("order_status", _S),
                      ("order_purchase_timestamp", _TS), ("order_approved_at", _TS),
                      ("order_delivered_carrier_date", _TS), ("order_delivered_customer_date", _TS),
                      ("order_estimated_delivery_date", _TS)),
    "products": _schema(("product_id", _S), ("product_category_name", _S), ("product_name_length", _I),
                        ("product_description_length", _I), ("product_photos_qty", _I),
                        ("product_weight_g", _I), ("product_length_cm", _I), ("product_height_cm", _I),
                        ("product_width_cm", _I)),
    "sellers": _schema(("seller_id", _S), ("seller_zip_code_prefix", _S), ("seller_city", _S),
                       ("seller_state", _S)),
    "category_translation": _schema(("product_category_name", _S), ("product_category_name_english", _S)),
    "geolocation": _schema(("geolocation_zip_code_prefix", _S), ("geolocation_lat", _D),
                           ("geolocation_lng", _D), ("geolocation_city", _S), ("geolocation_state", _S)),
}


def _declared(schema: T.StructType | str) -> T.StructType:
    if isinstance(schema, str):
        return SCHEMAS[schema] if schema in SCHEMAS else T.StructType.fromDDL(schema)
    return schema


def _named(path: str, columns: list[str], schema: T.StructType) -> dict[str, str]:
    """The header's spelling of every declared column, by its lower-case name."""
    given, wanted = {c.lower(): c for c in columns}, {f.name.lower() for f in schema}
    if set(given) != wanted or len(given) != len(columns):
        raise ValueError(f"{path}: missing columns {sorted(wanted - set(given))}, unknown or repeated columns "
                         f"{sorted(c for c in columns if c.lower() not in wanted or given[c.lower()] != c)}")
    return given


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             infer_schema: bool = False, bad_cells: str = "fail", **options: str) -> DataFrame:
    """Header-named CSV scan.

    ``schema`` is a ``StructType``, a DDL string or a key of ``SCHEMAS``; its
    columns are found by their names in the header, in any order and any
    case.  A missing or unknown column, and files of one folder with
    different headers, are errors; so is a cell that its type cannot hold,
    unless ``bad_cells="null"``.  Without a schema, types are inferred only
    when ``infer_schema`` is set; otherwise every column is a string.
    """
    reader = spark.read.option("header", True).options(**{"enforceSchema": "false"} | options)
    if schema is None:
        return reader.option("inferSchema", infer_schema).csv(path)
    schema = _declared(schema)
    cells = reader.csv(path)
    given = _named(path, cells.columns, schema)

    def typed(field: T.StructField) -> Column:
        cell = F.col(f"`{given[field.name.lower()]}`")
        value = cell.try_cast(field.dataType)
        if bad_cells == "null":
            return value.alias(field.name)
        told = F.concat(F.lit(f"{path}: {field.name} cannot be {field.dataType.simpleString()}: "), cell)
        return F.when(cell.isNotNull() & value.isNull(), F.raise_error(told)).otherwise(value).alias(field.name)

    return cells.select(*[typed(f) for f in schema])


class Loaded(NamedTuple):
    good: DataFrame                 # rows of the declared types
    bad: DataFrame                  # file, column, text: one row for each cell or row that is not


def load_csv(spark: SparkSession, path: str, schema: T.StructType | str, out: str, **options: str) -> Loaded:
    """One scan of the CSV files under ``path`` into ``out``: good rows typed, bad ones set aside with what is wrong.

    A row is bad if a cell is no value of its column's type, or if it has
    more or fewer cells than the header.  Of the first kind, every such cell
    gives its file, column and text; the second kind has no column and the
    whole row as text.  Rows are counted once: ``good.count()`` plus the
    distinct ``row`` of ``bad`` make all.  Columns are found by name as in
    ``read_csv``.  Both outputs are read from ``out``.
    """
    schema = _declared(schema)
    reader = spark.read.option("header", True).options(**{"enforceSchema": "false"} | options)
    names = reader.csv(path).columns
    given = _named(path, names, schema)
    cells = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_row"]])
    rows = reader.schema(cells).options(mode="PERMISSIVE", columnNameOfCorruptRecord="_row").csv(path)
    typed, faults = [], [F.when(F.col("_row").isNotNull(), F.struct(F.lit(None).cast("string").alias("column"), F.col("_row").alias("text")))]
    for field in schema:
        cell = F.col(f"`{given[field.name.lower()]}`")
        value = cell.try_cast(field.dataType)
        typed.append(value.alias(field.name))
        wrong = F.col("_row").isNull() & cell.isNotNull() & value.isNull()
        faults.append(F.when(wrong, F.struct(F.lit(field.name).alias("column"), cell.alias("text"))))
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))
    judged = rows.select(F.struct(*typed).alias("good"), place.alias("place"), F.array_compact(F.array(*faults)).alias("faults"))
    whole = T.StructType([*judged.schema.fields, T.StructField("bad", T.BooleanType())])
    judged.withColumn("bad", F.size("faults") > 0).write.partitionBy("bad").parquet(out)
    back = spark.read.schema(whole).parquet(out)
    bad = back.where("bad").select("place.file", "place.row", F.explode("faults").alias("fault"))
    return Loaded(back.where("NOT bad").select("good.*"), bad.select("file", "row", "fault.column", "fault.text"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_result(df: DataFrame, path: str, partition_by: list[str] | None = None,
                 mode: str = "errorifexists", fmt: str = "parquet") -> None:
    """Write a result instead of printing it.

    Partitioning by a low-cardinality column (e.g. a month key) lets later
    readers prune whole folders.  ``mode="replace_partitions"`` replaces the
    partitions that ``df`` has rows of and leaves all others as they are; a
    partition without rows in ``df`` stays.
    """
    if mode == "replace_partitions":
        if not partition_by:
            raise ValueError("replace_partitions needs partition_by")
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").format(fmt)
    else:
        writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_ordered(df: DataFrame, path: str, *order: Column | str, files: int | None = None,
                  mode: str = "errorifexists") -> None:
    """Write a result so that its order lasts: files hold ranges of the order, one after the other, each sorted.

    File names ascend with the order.  As ranges do not overlap, a reader's
    filter on the first order column skips files and row groups by their
    statistics.  Rows equal in all order columns lie in one file; add a
    tie-breaker where one value may hold many rows.  ``files`` (default: the
    shuffle partitions, as AQE coalesces them) is the number of ranges.
    """
    dealt = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).write.mode(mode).parquet(path)


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_ordered`` wrote, with ``position`` (file, row): sorting by it gives the written order without the order columns."""
    rows = spark.read.parquet(path)
    place = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    return rows.select("*", place.alias("position"))
