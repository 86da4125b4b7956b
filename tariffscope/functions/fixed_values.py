"""They decide results, so they are kept as they are."""

# Category that only groups others; its stated count is a roll-up.
UMBRELLA_SLUG = "ai-tools"

# Categories the umbrella stands for: this slug prefix, or one of these slugs.
ROLLUP_PREFIX = "ai-"
ROLLUP_SLUGS = ("llm",)

# Category whose prices are swap-fee percentages, not a monthly price.
NOT_COMPARABLE_SLUG = "dex"

# Category names that were title-cased from an acronym.
CATEGORY_NAME_FIXES = {
    "Crm": "CRM",
    "Dex": "DEX",
    "Vpn": "VPN",
    "Defi Tools": "DeFi Tools",
}

# Billing models listed on the billing board, in display order.
BILLING_MODELS = ("flat", "per-seat", "usage-based", "per-project")

# Plausible founding years and ratings (both ends included).
FOUNDED_YEARS = (1990, 2026)
RATING_RANGE = (0, 5)

# Smallest group taken into the analysis of variance, and the test level.
MIN_RATED_PER_GROUP = 5
ALPHA = 0.05

# Smallest category in the free leaderboard and the custom-price ranking.
MIN_ENTITIES_PER_CATEGORY = 5
MIN_OFFERS_PER_CATEGORY = 5

# Bars of the price histogram, and years in an age cohort.
HISTOGRAM_BINS = 30
COHORT_YEARS = 5
