"""OP-3 app taxonomy: master -> level -> lifestage (JN-2, JN-3, PRJ-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rfmlens.session import cut_lineage

TAXONOMY_COLUMNS = ("bundle", "app_l1_name", "app_l2_name", "app_l3_name", "lifestage_name")


def sized(df: DataFrame, name: str = "dimension") -> DataFrame:
    """A derived dimension with a true size estimate.

    Spark broadcasts a side whose estimate is below the session's
    ``spark.sql.autoBroadcastJoinThreshold``. Estimates of tables read from
    files are their bytes; those of joins compound as products and are far
    too high. Staging the small result gives it a file size, and the
    planner, not this library, decides by it.
    """
    return cut_lineage(df, name)


def app_taxonomy(master: DataFrame, level: DataFrame, lifestage: DataFrame) -> DataFrame:
    """Left joins keep every app of the master list, categorised or not."""
    return (master.join(level, "app_level_id", "left")
            .join(lifestage, "app_lifestage_id", "left")
            .select(*TAXONOMY_COLUMNS))
