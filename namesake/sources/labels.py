"""Label rounds: CSV files a person fills in, with line breaks inside cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namesake.functions.text import pair_cell

# Headings of the label files and the attributes each cell shows.
CELLS = {
    "name": ("xing", "ming"),
    "zihao": ("zihao",),
    "diqu": ("diqu",),
    "jigou": ("jigou_1", "jigou_2"),
    "guanzhi": ("guanzhi_1",),
    "chushen": ("chushen_1",),
    "rensheng&xian": ("ren_xian", "ren_sheng"),
}


def label_schema(with_scores: bool) -> T.StructType:
    fields = [T.StructField(c, T.StringType()) for c in CELLS]
    fields += [
        T.StructField("oracle", T.IntegerType()),
        T.StructField("year", T.StringType()),
        T.StructField("index", T.LongType()),
    ]
    if with_scores:
        fields += [
            T.StructField("predicted", T.DoubleType()),
            T.StructField("uncertainty", T.DoubleType()),
        ]
    return T.StructType(fields)


def label_cells(pairs: DataFrame, cells: dict[str, tuple[str, ...]] = CELLS, glued: str = "name") -> DataFrame:
    """Readable cells of pairs whose attributes are named ``1_x`` and ``2_x``.

    Attributes of one cell are parted by a space, those of ``glued`` are not.
    """
    def side(cell: str, n: int):
        sep = "" if cell == glued else " "
        return F.concat_ws(sep, *[F.col(f"{n}_{c}") for c in cells[cell]])

    shown = [pair_cell(side(c, 1), side(c, 2)).alias(c) for c in cells]
    year = pair_cell(F.col("1_year").cast("string"), F.col("2_year").cast("string"))
    extra = [c for c in ("predicted", "uncertainty") if c in pairs.columns]
    return pairs.select(
        *shown,
        F.lit(None).cast("int").alias("oracle"),
        year.alias("year"),
        F.col("pair_id").alias("index"),
        *extra,
    )


def write_to_label(cells: DataFrame, path: str, mode: str = "errorifexists", files: int | None = 1) -> None:
    """A round for a person to label: one file, as its rows are bounded by the round size.

    ``files=None`` leaves the number of files to the table, for more than a round.
    """
    placed = cells if files is None else cells.coalesce(files)
    placed.write.mode(mode).option("header", True).option("quoteAll", True).option(
        "escape", '"'
    ).csv(path)


def read_labels(spark: SparkSession, path: str, with_scores: bool = True) -> DataFrame:
    """Labelled pairs ``(pair_id, label)`` with the cells that were shown."""
    df = (
        spark.read.schema(label_schema(with_scores))
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
    )
    return df.withColumnsRenamed({"index": "pair_id", "oracle": "label"})
