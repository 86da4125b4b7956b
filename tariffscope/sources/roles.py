"""The five roles a catalogue is made of, and their declared schemas.

A role column has the name used throughout this package, the column name it
carries in a stored table (``stored_as``), and its type.  Stored tables may hold
booleans as 0/1 and dates as ISO text; ``to_role`` casts them once, at the source.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RoleColumn:
    name: str
    type: str
    stored_as: str
    stored_type: str

    def from_stored(self):
        value = F.col(self.stored_as).cast(self.type)
        if self.type == "double":  # not a number is no value; Spark would order it above all numbers
            value = F.nanvl(value, F.lit(None).cast("double"))
        return value.alias(self.name)


def _column(name: str, type: str, stored_as: str | None = None, stored_type: str | None = None):
    return RoleColumn(name, type, stored_as or name, stored_type or type)


@dataclass(frozen=True)
class Role:
    """``keys`` are the sets of columns a stored table holds unique; none = append-only."""

    table: str
    columns: tuple[RoleColumn, ...]
    keys: tuple[tuple[str, ...], ...] = ()

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def schema(self) -> str:
        """The role's schema as DDL."""
        return _ddl((c.name, c.type) for c in self.columns)

    @property
    def stored_schema(self) -> str:
        """The stored table's schema as DDL."""
        return _ddl((c.stored_as, c.stored_type) for c in self.columns)

    def stored_with(self, renamed: dict[str, str]) -> "Role":
        """The role with other stored column names (role name -> stored name)."""
        unknown = set(renamed) - set(self.names)
        if unknown:
            raise ValueError(f"{self.table} has no role columns {sorted(unknown)}")
        columns = tuple(
            RoleColumn(c.name, c.type, renamed.get(c.name, c.stored_as), c.stored_type)
            for c in self.columns
        )
        return Role(self.table, columns, self.keys)

    def to_role(self, stored: DataFrame) -> DataFrame:
        return stored.select(*(c.from_stored() for c in self.columns))


def _ddl(pairs) -> str:
    return ", ".join(f"`{name}` {type}" for name, type in pairs)


CATEGORY = Role(
    "categories",
    (
        _column("category_id", "bigint", "id"),
        _column("slug", "string"),
        _column("name", "string"),
        _column("description", "string"),
        _column("product_count", "bigint"),
    ),
    keys=(("category_id",), ("slug",)),
)

ENTITY = Role(
    "products",
    (
        _column("entity_id", "bigint", "id"),
        _column("slug", "string"),
        _column("name", "string"),
        _column("category_id", "bigint"),
        _column("description", "string"),
        _column("short_description", "string"),
        _column("website_url", "string"),
        _column("logo_url", "string"),
        _column("g2_rating", "double"),
        _column("capterra_rating", "double"),
        _column("overall_rating", "double"),
        _column("review_count", "bigint"),
        _column("founded_year", "int"),
        _column("hq_location", "string"),
        _column("has_free_tier", "boolean", stored_type="int"),
        _column("has_free_trial", "boolean", stored_type="int"),
        _column("last_updated", "date", stored_type="string"),
        _column("detail_url", "string"),
    ),
    keys=(("entity_id",), ("slug",)),
)

OFFER = Role(
    "pricing_plans",
    (
        _column("offer_id", "bigint", "id"),
        _column("entity_id", "bigint", "product_id"),
        _column("plan_name", "string"),
        _column("price_monthly", "double"),  # NULL = custom quote, 0 = free
        _column("price_annual", "double"),
        _column("billing_model", "string"),
        _column("currency", "string"),
        _column("features", "string"),  # a JSON array, kept as text
    ),
)

ATTRIBUTE = Role(
    "features",
    (
        _column("attribute_id", "bigint", "id"),
        _column("entity_id", "bigint", "product_id"),
        _column("feature_name", "string"),
        _column("feature_value", "string"),
        _column("category", "string"),
    ),
)

PRICE_LOG = Role(
    "price_history",
    (
        _column("log_id", "bigint", "id"),
        _column("entity_id", "bigint", "product_id"),
        _column("recorded_date", "date", stored_type="string"),
        _column("plan_name", "string"),
        _column("price", "double"),
        _column("notes", "string"),
    ),
)

ROLES: dict[str, Role] = {
    "category": CATEGORY,
    "entity": ENTITY,
    "offer": OFFER,
    "attribute": ATTRIBUTE,
    "price_log": PRICE_LOG,
}

# One row per entity, as a market export comes in one flat file.
FLAT_EXPORT_SCHEMA = (
    "tool_name string, category string, vertical string, free_plan boolean, "
    "starting_price_usd double, highest_plan_price_usd double, plan_count int, "
    "rating double, features_count int, website string"
)

# One row per category, as published benchmarks come.
BENCHMARK_SCHEMA = (
    "category string, vertical string, tool_count int, avg_rating double, "
    "median_price double, free_plan_pct int"
)

# Marts written by one stage and read by the next (see ``plans.build``).
MART_SCHEMAS: dict[str, str] = {
    "products_clean": (
        "entity_id bigint, name string, category_slug string, category_name string, "
        "overall_rating double, g2_rating double, capterra_rating double, review_count bigint, "
        "founded_year int, hq_location string, has_free_tier boolean, has_free_trial boolean, "
        "has_custom_pricing boolean, price_comparable boolean, entry_price double, "
        "max_price_monthly double, plan_count bigint, feature_count bigint, website_url string, "
        "detail_url string"
    ),
    "category_summary": (
        "category_slug string, category_name string, product_count bigint, avg_rating double, "
        "free_tier_count bigint, avg_feature_count double, avg_entry_price double, "
        "median_entry_price double, free_tier_pct double"
    ),
    "pricing_plans_clean": (
        "offer_id bigint, entity_id bigint, plan_name string, price_monthly double, "
        "price_annual double, billing_model string, currency string, features string, "
        "product_name string"
    ),
    "features_clean": (
        "attribute_id bigint, entity_id bigint, feature_name string, feature_value string, "
        "category string, is_true boolean"
    ),
}
