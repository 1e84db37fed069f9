"""Projection, type rules, missing values and result tidying."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise import constants as K
from foldwise.functions.scalar import is_missing


def drop_ids(df: DataFrame, ids: list[str] | None = None) -> DataFrame:
    return df.drop(*(K.ID_COLUMNS if ids is None else ids))


def feature_columns(df: DataFrame, exclude: list[str] | None = None) -> list[str]:
    """Columns that are not listed, in table order."""
    out = set(K.UNSCALED if exclude is None else exclude)
    return [c for c in df.columns if c not in out]


def split_xy(df: DataFrame, label: str = K.LABEL, drop: list[str] | None = None,
             keep: list[str] | None = None) -> DataFrame:
    """Features followed by the label; the other labels and the weight go. ``keep`` columns lead."""
    keep = keep or []
    gone = {label, *(drop if drop is not None else [K.ALT_LABEL, K.WEIGHT]), *keep}
    return df.select(*keep, *[c for c in df.columns if c not in gone], F.col(label).alias("label"))


def harmonise_types(df: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """Text and numbers to double, booleans to int; listed columns keep their type (booleans still become int)."""
    out = set(exclude or [])
    cols = []
    for name, dtype in df.dtypes:
        c = F.col(name)
        if dtype == "boolean":
            cols.append(c.cast("int").alias(name))
        elif name in out or dtype.startswith(("array", "map", "struct", "timestamp", "date")):
            cols.append(c)
        elif dtype == "string":
            cols.append(c.try_cast("double").alias(name))
        else:
            cols.append(c.cast("double").alias(name))
    return df.select(*cols)


def force_double(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in (K.FORCED_DOUBLE if cols is None else cols)})


def fill_zero(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """0 for null and for NaN in numeric columns."""
    types = dict(df.dtypes)
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return df.withColumns(
        {c: F.when(is_missing(F.col(c), types[c]), 0).otherwise(F.col(c)).cast(types[c]) for c in (numeric if cols is None else cols)}
    )


def null_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows and missing values per column, from one pass."""
    types = dict(df.dtypes)
    cols = df.columns if cols is None else cols
    wide = df.agg(F.count("*").alias("rows"), *[F.count_if(is_missing(F.col(c), types[c])).alias(f"_{i}") for i, c in enumerate(cols)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("missing")) for i, c in enumerate(cols)])
    return wide.select("rows", F.inline(pairs))


def align_schema(df: DataFrame, reference: T.StructType) -> DataFrame:
    """Columns of the reference schema, in its order and types; a missing column is an error."""
    absent = [f.name for f in reference.fields if f.name not in df.columns]
    if absent:
        raise ValueError(f"columns missing: {absent}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in reference.fields])


def schema_differences(df: DataFrame, reference: T.StructType) -> list[tuple[str, str, str]]:
    """(column, type here, type in the reference) where they differ."""
    here = dict(df.dtypes)
    there = {f.name: f.dataType.simpleString() for f in reference.fields}
    names = [*there, *[c for c in here if c not in there]]
    return [(n, here.get(n, "absent"), there.get(n, "absent")) for n in names if here.get(n) != there.get(n)]


def weight_features(df: DataFrame, cols: list[str], weight: str = "weight") -> DataFrame:
    """Listed columns (the label among them) times the square root of the row weight."""
    root = F.sqrt(F.col(weight))
    return df.withColumns({c: F.col(c) * root for c in cols})


def add_intercept(df: DataFrame, name: str = "const") -> DataFrame:
    return df.select(F.lit(1.0).alias(name), "*")


def tag(df: DataFrame, **values: object) -> DataFrame:
    """Run constants as columns."""
    return df.withColumns({c: F.lit(v) for c, v in values.items()})


def reorder(df: DataFrame, first: list[str], keep: list[str] | None = None) -> DataFrame:
    """Named columns first; the rest follow, or only those in ``keep``."""
    rest = [c for c in df.columns if c not in first] if keep is None else keep
    return df.select(*first, *rest)


def tidy_results(df: DataFrame, rename: dict[str, str] | None = None, strip: list[str] | None = None,
                 replace: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Trim and replace inside text columns, then rename."""
    edits: dict[str, Column] = {}
    for c, (old, new) in (replace or {}).items():
        edits[c] = F.replace(F.col(c), F.lit(old), F.lit(new))
    for c in strip or []:
        edits[c] = F.trim(edits.get(c, F.col(c)))
    out = df.withColumns(edits) if edits else df
    return out.withColumnsRenamed(rename or {})


def parse_source(df: DataFrame, path: str = "path") -> DataFrame:
    """Variant letter and fold number read from a table path such as ``.../CV3_train_df_A.parquet``."""
    name = F.regexp_extract(F.col(path), r"([^/]+?)(\.[A-Za-z0-9]+)?$", 1)
    return df.withColumns(
        {
            "fold": F.regexp_extract(name, r"CV(\d+)", 1).try_cast("int"),
            "split": F.regexp_extract(name, r"CV\d+_([a-z_]+?)_df", 1),
            "variant": F.regexp_extract(name, r"_([A-Z])$", 1),
        }
    )


def shape(df: DataFrame) -> DataFrame:
    """Row and column count."""
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))
