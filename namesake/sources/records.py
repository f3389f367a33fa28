"""Raw register, record, edition and candidate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namesake.functions import text
from namesake.operators.editions import edition_dimension
from namesake.operators.ordered import dense_index

# Raw register headings and the names they get.
RAW_COLUMNS = {
    "阳历年份": "year",
    "季节号": "season",
    "序号": "xuhao",
    "插补号": "interpol",
    "版本年号": "banben_nianhao",
    "版本年代": "banben_niandai",
    "版本季节": "banben_jijie",
    "地区": "diqu",
    "机构一": "jigou_1",
    "机构二": "jigou_2",
    "官职一": "guanzhi_1",
    "姓": "xing",
    "名": "ming",
    "字号": "zihao",
    "籍贯省": "ren_sheng",
    "籍贯县": "ren_xian",
    "出身一": "chushen_1",
}

# Converted register: a stable id, the derived year and edition, the rest text.
CONVERTED_SCHEMA = T.StructType(
    [T.StructField("record_id", T.LongType())]
    + [
        T.StructField(
            name,
            {"year": T.DoubleType(), "season": T.IntegerType()}.get(name, T.StringType()),
        )
        for name in RAW_COLUMNS.values()
    ]
    + [T.StructField("edition", T.StringType())]
)


def rename_columns(df: DataFrame, names: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Keep only the mapped columns, under their new names."""
    picked = [F.col(f"`{old}`").alias(new) for old, new in names.items()]
    return df.select(*keep, *picked)


def convert_raw(raw: DataFrame, record_id: str = "record_id") -> DataFrame:
    """Raw register with a record id (see ``read_csv``) -> converted register."""
    df = rename_columns(raw, RAW_COLUMNS, keep=(record_id,))
    return df.select(
        F.col(record_id).cast("long").alias("record_id"),
        text.fractional_year(F.col("year"), F.col("season")).alias("year"),
        F.col("season").cast("int").alias("season"),
        *[
            F.col(c).cast("string").alias(c)
            for c in RAW_COLUMNS.values()
            if c not in ("year", "season")
        ],
        text.edition_key(
            F.col("banben_nianhao"), F.col("banben_niandai"), F.col("banben_jijie")
        ).alias("edition"),
    )


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType = CONVERTED_SCHEMA,
    multi_line: bool = False,
    names: dict[str, str] | None = None,
    row_number: str | None = None,
) -> DataFrame:
    """CSV columns found by their headings, in the order and types of ``schema``.

    ``names`` maps a column to its heading where they differ. Empty cells are
    null, quotes inside cells are doubled, a value of another type is an error.
    A file is split over tasks unless ``multi_line`` says that cells may hold
    line breaks. ``row_number`` adds the number of each row, 0, 1, 2, ... in the
    order of the files' names and lines: blocks of a file are put in order by
    their place in it, whatever the order in which tasks take them.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    found = reader.csv(path).columns
    wanted = {f.name: (names or {}).get(f.name, f.name) for f in schema}
    missing = sorted(set(wanted.values()) - set(found))
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in {path}")
    kinds = {wanted[f.name]: f.dataType for f in schema}
    text = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in found])
    df = reader.schema(text).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    picked = [F.col(f"`{wanted[f.name]}`").alias(f.name) for f in schema]
    if row_number is None:
        return df.select(*picked)
    place = (F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_place"))
    return dense_index(df.select(*picked, *place), ["_file", "_block", "_place"], row_number).drop("_file", "_block", "_place")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def prepare_records(
    converted: DataFrame,
    match_cols: tuple[str, ...],
    required: str,
    edition: str = "edition",
    record_id: str = "record_id",
) -> tuple[DataFrame, DataFrame]:
    """Drop rows without the required attribute, fill missing, number editions.

    Returns the record table and the edition dimension.
    """
    present = converted.filter(F.col(required).isNotNull())
    editions = edition_dimension(present, edition, record_id)
    filled = present.withColumns({c: text.fill_missing(F.col(c)) for c in match_cols})
    return filled.join(editions.select(edition, "edition_seq"), edition), editions


def write_records(records: DataFrame, path: str, edition: str = "edition", mode: str = "errorifexists") -> None:
    """One folder per edition, so an edition filter prunes files."""
    records.write.mode(mode).partitionBy(edition).parquet(path)


def read_records(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """All editions, or those a condition keeps.

    Edition labels that look like numbers would be read back as numbers, so
    the partition column is cast to the text it was.
    """
    df = spark.read.parquet(path)
    if "edition" in df.columns:
        df = df.withColumn("edition", F.col("edition").cast("string"))
    return df if where is None else df.filter(where)


def read_edition(spark: SparkSession, path: str, edition: str) -> DataFrame:
    return read_records(spark, path, F.col("edition") == edition)


def read_edition_window(spark: SparkSession, path: str, start: int, window: int) -> DataFrame:
    """Records of ``window`` editions from position ``start`` on, from their folders alone.

    The labels of those editions are looked up first, in one column of the
    files; a window names few of them.
    """
    seq = F.col("edition_seq")
    inside = (seq >= start) & (seq < start + window)
    records = read_records(spark, path)
    labels = [r[0] for r in records.filter(inside).select("edition").distinct().collect()]
    return records.filter(F.col("edition").isin(labels) & inside)


def edition_counts(records: DataFrame, edition: str = "edition") -> DataFrame:
    return records.groupBy(edition).agg(F.count("*").alias("n_records"))


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Parquet sink of editions, candidates, features and results."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line: the attribute values of the pairs."""
    df.write.mode(mode).json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)
