"""Build and store the marts, each stage reading what the one before it wrote.

Reading a stored stage back, instead of planning on from it, is what keeps each
stage's work from being repeated by the next and cuts the lineage with it.
"""

from dataclasses import replace

from pyspark.sql import DataFrame

from ..sources.catalogue import Catalogue
from ..sources.readers import read_mart
from ..sources.roles import MART_SCHEMAS
from ..sources.writers import WRITERS, save_per_entity
from . import marts


def stage_per_entity(c: Catalogue, database: str, buckets: int) -> dict[str, DataFrame]:
    """Store entities and both summaries, bucketed alike, so that joining them needs no shuffle."""
    spark = c.entity.sparkSession
    frames = {
        "entity": c.entity,
        "offer_summary": marts.offer_summary(c),
        "attribute_summary": marts.attribute_summary(c),
    }
    for name, df in frames.items():
        save_per_entity(df, f"{database}.{name}", buckets)
    return {name: spark.table(f"{database}.{name}") for name in frames}


def staged_entity_mart(c: Catalogue, staged: dict[str, DataFrame], **options) -> DataFrame:
    """The entity mart over stored per-entity tables."""
    return marts.entity_mart(
        replace(c, entity=staged["entity"]),
        offers=staged["offer_summary"],
        attributes=staged["attribute_summary"],
        **options,
    )


def write_marts(
    c: Catalogue, root: str, format: str = "parquet", mart: DataFrame | None = None, **options
) -> dict[str, DataFrame]:
    """Write the four marts under ``root`` and return them as read back.

    ``mart`` is the entity mart if it is planned already; ``options`` go to ``entity_mart``.
    """
    spark, write = c.entity.sparkSession, WRITERS[format]
    mart = marts.entity_mart(c, **options) if mart is None else mart
    write(mart, f"{root}/products_clean")
    write(marts.offers_enriched(c), f"{root}/pricing_plans_clean")
    write(marts.clean_attributes(c), f"{root}/features_clean")
    stored_mart = read_mart(spark, root, "products_clean", format)
    write(marts.category_summary(stored_mart, c.category_is_small), f"{root}/category_summary")
    return {name: read_mart(spark, root, name, format) for name in MART_SCHEMAS}
