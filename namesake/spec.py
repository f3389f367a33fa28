"""What is linked: column roles and parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

# The attribute columns of the register and their roles.
MATCH_COLS = (
    "xing", "ming", "zihao", "diqu", "jigou_1", "jigou_2",
    "guanzhi_1", "ren_xian", "ren_sheng", "chushen_1",
)
BLOCK_COLS = ("xing", "ming")
GUARANTEE_COLS = ("xing", "ming", "ren_xian", "ren_sheng")


@dataclass(frozen=True)
class LinkageSpec:
    """Column roles and thresholds of one linkage task.

    A record table has a unique BIGINT ``record_id``, an integer position
    ``edition_seq`` of its edition, a DOUBLE ``year`` and STRING attributes.
    """

    record_id: str = "record_id"
    edition: str = "edition"
    edition_seq: str = "edition_seq"
    year: str = "year"
    match_cols: tuple[str, ...] = MATCH_COLS
    block_cols: tuple[str, ...] = BLOCK_COLS
    guarantee_cols: tuple[str, ...] = GUARANTEE_COLS
    name_col: str = "ming"
    rank_col: str | None = None

    window: int = 20
    top_k: int = 20
    buffered: bool = True
    require_present: bool = False
    phonetic_mode: str = "tokens"

    match_threshold: float = 0.5
    max_year_diff: float = 20.0

    min_size: int = 20
    max_breaks: int = 5
    max_break_ratio: float = 0.3
    denominator: str = "rows"

    def __post_init__(self):
        if self.window < 1 or self.top_k < 1:
            raise ValueError("window and top_k must be at least 1")
        if self.phonetic_mode not in ("tokens", "char_repr"):
            raise ValueError("phonetic_mode is 'tokens' or 'char_repr'")
        if self.denominator not in ("rows", "pairs"):
            raise ValueError("denominator is 'rows' or 'pairs'")
        for role in (self.block_cols, self.guarantee_cols, (self.name_col,)):
            missing = [c for c in role if c not in self.match_cols]
            if missing:
                raise ValueError(f"not among match_cols: {missing}")

    def validate(self, records: DataFrame) -> DataFrame:
        """Fail early when a record table lacks a column the spec names."""
        needed = [self.record_id, self.edition_seq, self.year, *self.match_cols]
        if self.rank_col:
            needed.append(self.rank_col)
        missing = [c for c in needed if c not in records.columns]
        if missing:
            raise ValueError(f"record table lacks columns: {missing}")
        return records

    @property
    def feature_names(self) -> list[str]:
        names = [f"{c}_stroke" for c in self.match_cols]
        names += [f"{c}_pinyin" for c in self.match_cols]
        if self.rank_col:
            names += [f"{self.rank_col}_diff", f"{self.rank_col}_lower"]
        n = self.name_col
        return names + [f"{n}_cnt_diff", f"{n}_sim1", f"{n}_sim2", "same_year"]
