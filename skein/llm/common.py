"""What every operator of this subpackage uses: tables in the shared folder, and columns of any name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.shared import forget  # noqa: F401
from skein.shared import shared_path as new_path  # noqa: F401
from skein.shared import ship  # noqa: F401
from skein.shared import stored as written  # noqa: F401


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that df doesn't have yet, whatever its columns are called."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while (name := f"_{name}").lower() in taken:
            pass
        taken.add(name.lower())
        out.append(name)
    return out


def packed(df: DataFrame, *columns: str) -> DataFrame:
    """``row`` with all of df, and the columns an operator reads: whatever else df has, names can't clash."""
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), *columns)
