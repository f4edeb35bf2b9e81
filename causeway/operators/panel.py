"""Condition panel: yearly inspection sheets, next-year pairs, splits and imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions import scalars as S

#: The sheet's columns.
SHEET = {
    "state_code": "STATE_CODE_001", "structure_id": "STRUCTURE_NUMBER_008", "year_built": "YEAR_BUILT_027", "year_rehab": "YEAR_RECONSTRUCTED_106",
    "material": "STRUCTURE_KIND_043A", "design_load": "DESIGN_LOAD_031", "spans": "MAIN_UNIT_SPANS_045", "max_span_m": "MAX_SPAN_LEN_MT_048",
    "struct_len_m": "STRUCTURE_LEN_MT_049", "deck_width_m": "DECK_WIDTH_MT_052", "adt": "ADT_029", "truck_pct": "PERCENT_ADT_TRUCK_109",
    "deck": "DECK_COND_058", "super": "SUPERSTRUCTURE_COND_059", "sub": "SUBSTRUCTURE_COND_060", "culvert": "CULVERT_COND_062",
}
FEATURES = ["age", "years_since_rehab", "material", "design_load", "spans", "max_span_m", "struct_len_m", "deck_width_m", "adt", "truck_pct", "state4"]


def panel_of(sheet: DataFrame) -> DataFrame:
    """The panel of an all-text sheet with a ``year`` column; rows without a rating go.

    Optional columns may be absent; the state code and the structure's number may not.
    """
    for name in ("state_code", "structure_id"):
        if SHEET[name] not in sheet.columns:
            raise KeyError(SHEET[name])
    text = {n: S.column_or_null(sheet, c) for n, c in SHEET.items()}
    numbers = {n: S.number(text[n]).alias(n) for n in SHEET if n not in ("state_code", "structure_id")}
    raw = sheet.select(
        F.trim(text["state_code"]).alias("state_code"), F.trim(text["structure_id"]).alias("structure_id"),
        S.structure_key(text["state_code"], text["structure_id"]).alias("key"), F.col("year").cast("int").alias("year"), *numbers.values(),
    )
    state = S.condition_state(*(F.col(c) for c in ("deck", "super", "sub", "culvert")))
    out = raw.withColumns({
        "state4": state, "rating": state,
        "age": S.age_at(F.col("year").cast("double"), F.col("year_built")),
        "years_since_rehab": S.years_since(F.col("year").cast("double"), F.col("year_rehab")),
    })
    order = ["state_code", "structure_id", "key", "year", "year_built", "year_rehab", "material", "design_load", "spans", "max_span_m", "struct_len_m", "deck_width_m", "adt", "truck_pct", "rating", "state4", "age", "years_since_rehab"]
    return out.where(F.col("state4").isNotNull()).select(*order)


def next_year_pairs(panel: DataFrame, value: str = "state4") -> DataFrame:
    """Each row with the same key's value a year later, as ``y_next``; gaps give no pair, repeated rows multiply."""
    later = panel.select("key", (F.col("year") - 1).alias("year"), F.col(value).alias("y_next"))
    return panel.join(later, ["key", "year"])


def split_by_year(panel: DataFrame, train_max: int, test_min: int) -> tuple[DataFrame, DataFrame]:
    train, test = panel.where(F.col("year") <= train_max), panel.where(F.col("year") >= test_min)
    if train.isEmpty() or test.isEmpty():
        raise ValueError("both sides of the split need rows")
    return train, test


def feature_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row of exact medians."""
    return df.agg(*(F.median(c).alias(c) for c in columns))


def imputed(df: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` with nulls replaced by the table's own medians, and by 0 where all are null."""
    medians = feature_medians(df, columns).select(*(F.col(c).alias(f"_m_{c}") for c in columns))
    wide = df.join(F.broadcast(medians))  # one row
    return wide.withColumns({c: F.coalesce(c, f"_m_{c}", F.lit(0.0)).cast("double") for c in columns}).drop(*medians.columns)
