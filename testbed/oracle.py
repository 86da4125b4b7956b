"""The queries of ``registry`` as SQL for DuckDB, written independently of the plans.

Role tables are common table expressions over the test tables, as in ``binding``.
"""

from . import binding as b


def _up(x: str, places: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(28,10)), {places}) AS DOUBLE)"


def _even(x: str, places: int) -> str:
    return f"CAST(round_even(CAST({x} AS DECIMAL(28,10)), {places}) AS DOUBLE)"


def _pct(part: str, whole: str) -> str:
    return f"(100.0 * CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0))"


def _listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_TABLES = {
    "category": """
    SELECT CAST(n_nationkey AS BIGINT) AS category_id,
           lower(replace(r_name, ' ', '_') || '-' || n_name) AS slug, n_name AS name,
           CASE WHEN n_nationkey = 24 THEN CAST(4 AS BIGINT)
                ELSE CAST((SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey)
                          - CASE WHEN n_nationkey % 6 = 0 THEN 1 ELSE 0 END AS BIGINT) END AS product_count
    FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL
    SELECT CAST(-1 AS BIGINT), 'asia', 'Asia', CAST(count(*) AS BIGINT)
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'""",
    "entity": """
    SELECT c_custkey AS entity_id, lower(c_name) AS slug, c_name AS name,
           CAST(CASE WHEN c_nationkey = 24 AND c_custkey % 40 <> 7 THEN 23 ELSE c_nationkey END AS BIGINT) AS category_id,
           c_acctbal / 2000 AS g2_rating,
           CASE WHEN c_acctbal >= 0 THEN 5 - c_acctbal / 2000 END AS capterra_rating,
           CASE WHEN c_acctbal >= 0 THEN c_acctbal / 2000 END AS overall_rating,
           CAST(0 AS BIGINT) AS review_count,
           CAST(CASE WHEN c_custkey % 50 <> 0 THEN 1980 + c_custkey % 50 END AS INTEGER) AS founded_year,
           c_mktsegment AS hq_location,
           c_mktsegment IN ('BUILDING', 'FURNITURE', 'HOUSEHOLD') AS has_free_tier,
           c_mktsegment = 'MACHINERY' AS has_free_trial,
           'https://example.org/' || CAST(c_custkey AS VARCHAR) AS website_url,
           '/tools/' || lower(c_name) AS detail_url
    FROM customer""",
    "offer": """
    SELECT o_orderkey AS offer_id,
           CASE WHEN o_custkey % 40 = 7 AND o_orderkey % 8 <> 0 THEN o_custkey - 1 ELSE o_custkey END AS entity_id,
           o_orderstatus AS plan_name,
           CASE WHEN o_orderstatus = 'P' THEN NULL
                WHEN o_orderpriority = '5-LOW' THEN CAST(0 AS DOUBLE)
                ELSE CAST(floor(o_totalprice / 25000) + 1 AS DOUBLE) * 25 END AS price_monthly,
           o_totalprice / 100 AS price_annual,
           CASE WHEN o_orderkey % 29 <> 4 THEN o_orderpriority END AS billing_model,
           'USD' AS currency,
           CASE o_orderkey % 12 WHEN 0 THEN NULL WHEN 1 THEN '[]' WHEN 2 THEN '["' || o_orderpriority || '"'
                WHEN 3 THEN '{"a": 1}' WHEN 4 THEN ' ' WHEN 5 THEN 'null' WHEN 6 THEN '["a"] and more'
                WHEN 7 THEN '["Twice", "Twice", 7, {"x": 1}]'
                ELSE '["' || o_orderpriority || '", " Plan ' || o_orderstatus || ' ", null, "", "tier '
                     || CAST(o_orderkey % 7 AS VARCHAR) || '"]' END AS features
    FROM orders""",
    "attribute": """
    SELECT event_id AS attribute_id, user_id AS entity_id,
           event_type || '_' || CAST(event_id % 5 AS VARCHAR) AS feature_name,
           CASE event_id % 4 WHEN 0 THEN 'True' WHEN 1 THEN 'true' WHEN 2 THEN 'False'
                ELSE 'n/a' END AS feature_value,
           event_type AS category
    FROM events""",
    "listing": """
    SELECT *, CASE WHEN features IS NULL OR trim(features) = '' THEN 'missing'
                   WHEN NOT json_valid(features) THEN 'malformed'
                   WHEN json_type(features) = 'NULL' THEN 'missing'
                   WHEN json_type(features) <> 'ARRAY' THEN 'malformed'
                   WHEN len(list_filter(from_json(features, '["JSON"]'), lambda x: trim(x ->> '$') <> '')) = 0 THEN 'empty'
                   ELSE 'listed' END AS status
    FROM offer""",
    "highlight": """
    SELECT * FROM (
        SELECT offer_id, entity_id, plan_name, price_monthly, unnest(range(1, len(items) + 1)) AS place,
               trim(unnest(items) ->> '$') AS highlight
        FROM (SELECT *, from_json(features, '["JSON"]') AS items FROM listing WHERE status = 'listed'))
    WHERE highlight <> ''""",
    "price_log": """
    SELECT o_orderkey AS log_id, CASE WHEN o_orderkey % 4 = 1 THEN 1 ELSE o_custkey END AS entity_id,
           CAST(CASE WHEN o_orderkey % 3 = 0 THEN date_trunc('month', o_orderdate) ELSE o_orderdate END AS DATE)
               AS recorded_date,
           CASE WHEN o_orderkey % 17 <> 3 THEN o_orderstatus END AS plan_name,
           CASE WHEN o_orderkey % 13 <> 5 THEN CAST(floor(o_totalprice / 100000) AS DOUBLE) * 10 END AS price
    FROM orders""",
    "daily": """
    SELECT entity_id, plan_name, recorded_date, price FROM price_log
    QUALIFY row_number() OVER (PARTITION BY entity_id, plan_name, recorded_date ORDER BY log_id DESC) = 1""",
    "logged": """
    SELECT daily.*, lag(price) OVER w AS old_price, lag(recorded_date) OVER w AS previous_date
    FROM daily WINDOW w AS (PARTITION BY entity_id, plan_name ORDER BY recorded_date)""",
    "monthly": """
    WITH ends AS (
        SELECT entity_id, plan_name, date_trunc('month', recorded_date)::DATE AS ended, price FROM daily
        QUALIFY row_number() OVER (PARTITION BY entity_id, plan_name, ended ORDER BY recorded_date DESC) = 1),
    reach AS (SELECT entity_id, plan_name, min(ended) AS lo, max(ended) AS hi FROM ends GROUP BY ALL),
    calendar AS (
        SELECT entity_id, plan_name, unnest(generate_series(lo, hi, INTERVAL 1 MONTH))::DATE AS month FROM reach)
    SELECT c.entity_id, c.plan_name, c.month, e.price, e.ended = c.month AS is_recorded
    FROM calendar c ASOF JOIN (SELECT entity_id, plan_name, coalesce(plan_name, '?') AS plan, ended, price FROM ends) e
         ON c.entity_id = e.entity_id AND coalesce(c.plan_name, '?') = e.plan AND c.month >= e.ended""",
    "entry": """
    SELECT entity_id, min(price_monthly) AS entry_price
    FROM offer WHERE price_monthly > 0 GROUP BY entity_id""",
    "clean_category": f"""
    SELECT category_id, slug AS category_slug, product_count,
           CASE name {" ".join(f"WHEN '{old}' THEN '{new}'" for old, new in b.NAME_FIXES.items())}
                ELSE name END AS category_name
    FROM category WHERE slug <> '{b.UMBRELLA}'""",
    "mart": f"""
    SELECT e.entity_id, e.name, k.category_slug, k.category_name, e.overall_rating, e.g2_rating,
           e.capterra_rating, e.review_count, e.founded_year, e.hq_location,
           e.has_free_tier, e.has_free_trial,
           coalesce(o.has_custom_pricing, FALSE) AS has_custom_pricing,
           k.category_slug IS DISTINCT FROM '{b.NOT_COMPARABLE}' AS price_comparable,
           p.entry_price, o.max_price_monthly, o.plan_count,
           coalesce(a.feature_count, 0) AS feature_count, e.website_url, e.detail_url
    FROM entity e
    LEFT JOIN clean_category k ON k.category_id = e.category_id
    LEFT JOIN entry p ON p.entity_id = e.entity_id
    LEFT JOIN (SELECT entity_id, count(*) AS plan_count, max(price_monthly) AS max_price_monthly,
                      count(*) > count(price_monthly) AS has_custom_pricing
               FROM offer GROUP BY entity_id) o ON o.entity_id = e.entity_id
    LEFT JOIN (SELECT entity_id, count(*) AS feature_count
               FROM attribute WHERE lower(feature_value) = 'true'
               GROUP BY entity_id) a ON a.entity_id = e.entity_id""",
    "summary": f"""
    SELECT category_slug, category_name, count(*) AS product_count,
           {_even("avg(overall_rating)", 2)} AS avg_rating,
           count(*) FILTER (WHERE has_free_tier) AS free_tier_count,
           {_even("avg(feature_count)", 2)} AS avg_feature_count,
           {_even("avg(entry_price) FILTER (WHERE price_comparable)", 2)} AS avg_entry_price,
           {_even("median(entry_price) FILTER (WHERE price_comparable)", 2)} AS median_entry_price,
           {_even(_pct("count(*) FILTER (WHERE has_free_tier)", "count(*)"), 1)} AS free_tier_pct
    FROM mart WHERE category_slug IS NOT NULL AND category_name IS NOT NULL
    GROUP BY category_slug, category_name""",
    "placed": """
    SELECT *, CASE WHEN category_slug NOT LIKE 'europe-%' THEN split_part(category_slug, '-', 1) END AS vertical
    FROM mart""",
    "paired": """
    SELECT * FROM mart
    WHERE price_comparable AND overall_rating IS NOT NULL AND entry_price > 0""",
    "enriched": """
    SELECT o.*, e.name AS product_name FROM offer o LEFT JOIN entity e ON e.entity_id = o.entity_id""",
}


def _over(*tables: str, query: str) -> str:
    """``query`` with the named role tables, and what they need, in front."""
    needs = {
        "entry": ["offer"],
        "clean_category": ["category"],
        "mart": ["clean_category", "entity", "entry", "attribute"],
        "summary": ["mart"],
        "paired": ["mart"],
        "placed": ["mart"],
        "enriched": ["offer", "entity"],
        "listing": ["offer"],
        "highlight": ["listing"],
        "daily": ["price_log"],
        "logged": ["daily"],
        "monthly": ["daily"],
    }
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in needs.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in tables:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({_TABLES[n]})" for n in ordered) + "\n" + query


_PANELS = 20000  # of Simpson's rule, for p-values


def _simpson(density: str, upper: str) -> str:
    """Integral of ``density`` (of x) from 0 to ``upper``, over the rows of ``test``."""
    weight = f"CASE WHEN i IN (0, {_PANELS}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"""(SELECT sum({weight} * ({density})) * any_value({upper}) / {_PANELS} / 3
        FROM (SELECT test.*, i, {upper} * i / {_PANELS} AS x
              FROM test, range(0, {_PANELS + 1}) steps(i)))"""


def _correlation(x: str, y: str) -> str:
    density = (
        "exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * pow(1 + x * x / v, -(v + 1) / 2)"
    )
    return _over(
        "paired",
        query=f""",
basic AS (SELECT count(*) AS n, corr({y}, {x}) AS r FROM paired),
test AS (SELECT n, r, CAST(n - 2 AS DOUBLE) AS v, abs(r * sqrt((n - 2) / (1 - r * r))) AS size,
                r * sqrt((n - 2) / (1 - r * r)) AS t FROM basic),
result AS (SELECT n, r, t, 1 - 2 * {_simpson(density, "size")} AS p FROM test)
SELECT n, {_up("r", 6)} AS r, {_up("t", 6)} AS t, {_up("p", 6)} AS p, p < 0.05 AS significant
FROM result""",
    ).replace(")\n,\n", "),\n")


def _anova() -> str:
    density = (
        "exp(lgamma((d1 + d2) / 2) - lgamma(d1 / 2) - lgamma(d2 / 2) + d1 / 2 * ln(d1 / d2))"
        " * pow(x, d1 / 2 - 1) * pow(1 + d1 * x / d2, -(d1 + d2) / 2)"
    )
    return _over(
        "mart",
        query=f""",
rated AS (SELECT category_slug, overall_rating AS y,
                 avg(overall_rating) OVER (PARTITION BY category_slug) AS own_mean,
                 count(*) OVER (PARTITION BY category_slug) AS size
          FROM mart WHERE category_slug IS NOT NULL AND overall_rating IS NOT NULL),
kept AS (SELECT *, avg(y) OVER () AS grand_mean FROM rated WHERE size >= 5),
squares AS (SELECT count(DISTINCT category_slug) - 1 AS df_between,
                   count(*) - count(DISTINCT category_slug) AS df_within,
                   sum((own_mean - grand_mean) * (own_mean - grand_mean)) AS between_squares,
                   sum((y - own_mean) * (y - own_mean)) AS within_squares FROM kept),
test AS (SELECT df_between, df_within, CAST(df_between AS DOUBLE) AS d1,
                CAST(df_within AS DOUBLE) AS d2,
                (between_squares / df_between) / (within_squares / df_within) AS f FROM squares),
result AS (SELECT df_between, df_within, f, 1 - {_simpson(density, "f")} AS p FROM test)
SELECT df_between, df_within, {_up("f", 6)} AS f, {_up("p", 6)} AS p, p < 0.05 AS significant
FROM result""",
    ).replace(")\n,\n", "),\n")


def _extreme(finding: str, column: str, direction: str) -> str:
    return f"""(SELECT '{finding}' AS finding, category_name, {column} AS value FROM summary
    WHERE {column} IS NOT NULL ORDER BY {column} {direction}, product_count, category_slug DESC LIMIT 1)"""


_RATINGS = "g2_rating, capterra_rating, overall_rating"

ORACLES: dict[str, str] = {
    "dq_table_row_counts": _over(
        "category",
        query="""
SELECT 'categories' AS table_name, count(*) AS row_count FROM category
UNION ALL SELECT 'products', count(*) FROM customer
UNION ALL SELECT 'pricing_plans', count(*) FROM orders
UNION ALL SELECT 'features', count(*) FROM events
UNION ALL SELECT 'price_history', count(*) FROM orders""",
    ),
    "category_listing": _over(
        "category",
        query="SELECT slug, name, product_count FROM category ORDER BY product_count DESC, slug",
    ),
    "dq_count_reconcile": _over(
        "category", "entity",
        query="""
SELECT slug, product_count AS stated_count, actual AS actual_count
FROM (SELECT k.slug, k.product_count,
             (SELECT count(*) FROM entity e WHERE e.category_id = k.category_id) AS actual
      FROM category k)
WHERE product_count <> actual""",
    ),
    "dq_missing_rating": _over(
        "entity",
        query=f"SELECT entity_id, name, {_RATINGS} FROM entity WHERE overall_rating IS NULL",
    ),
    "dq_custom_offers": _over(
        "entity", "offer",
        query="""
SELECT e.name, o.plan_name, o.price_monthly, o.billing_model
FROM entity e JOIN offer o USING (entity_id)
WHERE o.price_monthly IS NULL ORDER BY e.name, o.offer_id""",
    ),
    "dq_custom_share": _over(
        "offer",
        query=f"""
SELECT {_up(_pct("count(*) - count(price_monthly)", "count(*)"), 1)} AS pct_custom_pricing FROM offer""",
    ),
    "dq_duplicate_keys": """
SELECT lower(p_name) AS slug, count(*) AS row_count FROM part GROUP BY 1 HAVING count(*) > 1""",
    "load_first_wins": """
SELECT p_partkey AS part_id, lower(p_name) AS slug, p_brand FROM part p
WHERE NOT EXISTS (SELECT 1 FROM part q
                  WHERE lower(q.p_name) = lower(p.p_name) AND q.p_partkey < p.p_partkey)""",
    "dq_entities_without_offers": _over(
        "entity", "offer",
        query="""
SELECT entity_id, name FROM entity e
WHERE NOT EXISTS (SELECT 1 FROM offer o WHERE o.entity_id = e.entity_id)""",
    ),
    "dq_entities_without_attributes": _over(
        "entity", "attribute",
        query="""
SELECT entity_id, name FROM entity e
WHERE NOT EXISTS (SELECT 1 FROM attribute a WHERE a.entity_id = e.entity_id)""",
    ),
    "dq_year_outliers": _over(
        "entity",
        query="""
SELECT entity_id, name, founded_year FROM entity
WHERE coalesce(founded_year, 0) NOT BETWEEN 1990 AND 2026""",
    ),
    "dq_unit_mismatch_probe": _over(
        "category", "entity", "offer",
        query=f"""
SELECT e.name, o.plan_name, o.price_monthly, o.billing_model
FROM category k JOIN entity e USING (category_id) JOIN offer o USING (entity_id)
WHERE k.slug = '{b.NOT_COMPARABLE}' AND o.price_monthly > 0
ORDER BY o.price_monthly, o.offer_id LIMIT 10""",
    ),
    "dq_placeholder_profile": _over(
        "entity",
        query=f"""
SELECT min(review_count) AS min_value, max(review_count) AS max_value,
       {_up("avg(review_count)", 6)} AS avg_value FROM entity""",
    ),
    "dq_rating_out_of_range": _over(
        "entity",
        query=f"""
SELECT entity_id, name, {_RATINGS} FROM entity
WHERE g2_rating < 0 OR g2_rating > 5 OR capterra_rating < 0 OR capterra_rating > 5
   OR overall_rating < 0 OR overall_rating > 5""",
    ),
    "dq_umbrella_rollup": _over(
        "category", "entity",
        query=f"""
SELECT count(*) AS subcategory_total FROM entity WHERE category_id IN (
    SELECT category_id FROM category
    WHERE slug ILIKE '{b.ROLLUP_PREFIX}%' OR slug IN ({_listed(b.ROLLUP_SLUGS)}))""",
    ),
    "dq_value_variants": _over(
        "attribute",
        query="""
SELECT feature_value, count(*) AS row_count, lower(feature_value) AS lowered
FROM attribute GROUP BY feature_value""",
    ),
    "dq_mart_counters": _over(
        "summary",
        query="""
SELECT 'products_clean_rows' AS counter, count(*) AS value FROM mart
UNION ALL SELECT 'missing_rating', count(*) FROM mart WHERE overall_rating IS NULL
UNION ALL SELECT 'with_custom_price', count(*) FROM mart WHERE has_custom_pricing
UNION ALL SELECT 'category_summary_rows', count(*) FROM summary
UNION ALL SELECT 'pricing_plans_clean_rows', count(*) FROM orders
UNION ALL SELECT 'features_clean_rows', count(*) FROM events""",
    ),
    "clean_categories": _over(
        "clean_category",
        query="SELECT category_id, category_slug, category_name, product_count FROM clean_category",
    ),
    "clean_attributes": _over(
        "attribute",
        query="""
SELECT attribute_id, entity_id, feature_name, lower(feature_value) AS feature_value, category,
       lower(feature_value) = 'true' AS is_true FROM attribute""",
    ),
    "attribute_summary": _over(
        "attribute",
        query="""
SELECT entity_id, count(*) AS feature_count FROM attribute
WHERE lower(feature_value) = 'true' GROUP BY entity_id""",
    ),
    "offer_summary": _over(
        "offer", "entry",
        query="""
SELECT o.entity_id, o.plan_count, o.has_custom_pricing, o.max_price_monthly, e.entry_price
FROM (SELECT entity_id, count(*) AS plan_count, max(price_monthly) AS max_price_monthly,
             count(*) > count(price_monthly) AS has_custom_pricing FROM offer GROUP BY entity_id) o
LEFT JOIN entry e ON e.entity_id = o.entity_id""",
    ),
    "entity_mart": _over("mart", query="SELECT * FROM mart"),
    "category_summary": _over(
        "summary", query="SELECT * FROM summary ORDER BY product_count DESC, category_slug"
    ),
    "offers_enriched": _over("enriched", query="SELECT * FROM enriched"),
    "q01_entry_price_by_category": _over(
        "category", "entity", "entry",
        query=f"""
SELECT k.name AS category, count(DISTINCT e.entity_id) AS product_count,
       {_up("avg(p.entry_price)", 2)} AS avg_entry_price,
       {_up("min(p.entry_price)", 2)} AS min_entry_price,
       {_up("max(p.entry_price)", 2)} AS max_entry_price
FROM category k JOIN entity e USING (category_id) JOIN entry p USING (entity_id)
WHERE k.slug <> '{b.NOT_COMPARABLE}'
GROUP BY k.category_id, k.name ORDER BY avg_entry_price DESC""",
    ),
    "q02_free_tier_share": _over(
        "category", "entity",
        query=f"""
SELECT k.name AS category, count(DISTINCT e.entity_id) AS product_count,
       count(*) FILTER (WHERE e.has_free_tier) AS free_tier_count,
       {_up(_pct("count(*) FILTER (WHERE e.has_free_tier)", "count(DISTINCT e.entity_id)"), 1)}
           AS free_tier_pct
FROM category k JOIN entity e USING (category_id)
GROUP BY k.category_id, k.name ORDER BY free_tier_pct DESC""",
    ),
    "q03_billing_model_mix": _over(
        "offer",
        query=f"""
SELECT billing_model, count(price_monthly) AS plan_count,
       {_up("avg(price_monthly)", 2)} AS avg_price_monthly
FROM offer GROUP BY billing_model HAVING count(price_monthly) > 0 ORDER BY plan_count DESC""",
    ),
    "q04_top_rated": _over(
        "category", "entity",
        query=f"""
SELECT e.name, k.name AS category, {_RATINGS}, review_count
FROM category k JOIN entity e USING (category_id) WHERE overall_rating IS NOT NULL
ORDER BY overall_rating DESC, review_count DESC, entity_id LIMIT 10""",
    ),
    "q05_category_leaders": _over(
        "category", "entity",
        query="""
SELECT category, top_product, overall_rating
FROM (SELECT k.name AS category, e.name AS top_product, e.overall_rating,
             rank() OVER (PARTITION BY e.category_id ORDER BY e.overall_rating DESC) AS place
      FROM category k JOIN entity e USING (category_id) WHERE e.overall_rating IS NOT NULL)
WHERE place = 1 ORDER BY overall_rating DESC""",
    ),
    "q06_attributes_vs_price": _over(
        "entity", "attribute", "entry",
        query="""
SELECT e.name, a.feature_count, p.entry_price
FROM (SELECT entity_id, count(*) AS feature_count FROM attribute
      WHERE lower(feature_value) = 'true' GROUP BY entity_id) a
JOIN entry p USING (entity_id) JOIN entity e USING (entity_id) ORDER BY feature_count DESC""",
    ),
    "q07_best_free": _over(
        "category", "entity",
        query="""
SELECT e.name, k.name AS category, e.overall_rating, e.review_count
FROM category k JOIN entity e USING (category_id)
WHERE e.has_free_tier AND e.overall_rating IS NOT NULL AND k.product_count >= 5
ORDER BY e.overall_rating DESC, e.review_count DESC, e.entity_id LIMIT 15""",
    ),
    "q08_custom_price_by_category": _over(
        "category", "entity", "offer",
        query=f"""
SELECT k.name AS category, count(*) AS total_plans,
       count(*) - count(o.price_monthly) AS custom_price_plans,
       {_up(_pct("count(*) - count(o.price_monthly)", "count(*)"), 1)} AS custom_price_pct
FROM category k JOIN entity e USING (category_id) JOIN offer o USING (entity_id)
GROUP BY k.category_id, k.name HAVING count(*) >= 5 ORDER BY custom_price_pct DESC""",
    ),
    "q09_age_cohort": _over(
        "entity", "entry",
        query=f"""
SELECT CAST((e.founded_year // 5) * 5 AS BIGINT) AS founded_period_start, count(*) AS product_count,
       {_up("avg(e.overall_rating)", 2)} AS avg_rating,
       {_up("avg(p.entry_price)", 2)} AS avg_entry_price
FROM entity e LEFT JOIN entry p USING (entity_id) WHERE e.founded_year IS NOT NULL
GROUP BY 1 ORDER BY 1""",
    ),
    "q10_attribute_group_price": _over(
        "attribute", "entry",
        query=f"""
SELECT a.category AS feature_category, count(DISTINCT a.entity_id) AS product_count,
       {_up("avg(p.entry_price)", 2)} AS avg_entry_price_of_adopters
FROM attribute a JOIN entry p USING (entity_id) WHERE lower(a.feature_value) = 'true'
GROUP BY a.category ORDER BY avg_entry_price_of_adopters DESC""",
    ),
    "q11_common_attributes": _over(
        "attribute",
        query="""
SELECT feature_name, category, count(*) AS product_count FROM attribute
WHERE lower(feature_value) = 'true' GROUP BY feature_name, category
ORDER BY product_count DESC, feature_name, category LIMIT 15""",
    ),
    "q12_value_score": _over(
        "category", "entity", "entry",
        query=f"""
SELECT e.name, k.name AS category, e.overall_rating, p.entry_price,
       {_up("e.overall_rating / p.entry_price", 3)} AS value_score
FROM category k JOIN entity e USING (category_id) JOIN entry p USING (entity_id)
WHERE e.overall_rating IS NOT NULL ORDER BY value_score DESC, e.entity_id LIMIT 15""",
    ),
    "view_category_stats": _over(
        "category", "entity", "offer", "entry",
        query=f"""
SELECT k.name, k.slug, k.product_count, {_up("avg(e.overall_rating)", 2)} AS avg_rating,
       {_up("avg(o.price_monthly)", 2)} AS avg_starting_price,
       {_up(_pct("count(*) FILTER (WHERE e.has_free_tier)", "count(*)"), 1)} AS free_tier_pct
FROM category k JOIN entity e USING (category_id)
LEFT JOIN entry p ON p.entity_id = e.entity_id
LEFT JOIN offer o ON o.entity_id = e.entity_id AND o.price_monthly = p.entry_price
GROUP BY k.category_id, k.name, k.slug, k.product_count""",
    ),
    "view_category_offers": _over(
        "category", "entity", "offer",
        query=f"""
SELECT e.name, e.slug, e.overall_rating, e.has_free_tier, o.plan_name, o.price_monthly,
       o.billing_model
FROM category k JOIN entity e USING (category_id) JOIN offer o USING (entity_id)
WHERE k.slug = '{b.SHOWN_CATEGORY}' ORDER BY o.price_monthly NULLS FIRST, o.offer_id""",
    ),
    "view_free_entities": _over(
        "category", "entity",
        query="""
SELECT e.name, e.slug, k.name AS category, e.overall_rating, e.detail_url
FROM category k JOIN entity e USING (category_id)
WHERE e.has_free_tier ORDER BY e.overall_rating DESC NULLS LAST, e.entity_id""",
    ),
    "stat_median_entry_price": _over(
        "mart",
        query="SELECT median(entry_price) AS median_entry_price FROM mart WHERE price_comparable",
    ),
    "top_categories_by_price": _over(
        "summary",
        query="""
SELECT category_slug, category_name, avg_entry_price FROM summary
ORDER BY avg_entry_price DESC NULLS LAST, category_slug LIMIT 15""",
    ),
    "category_extremes": _over(
        "summary",
        query="\nUNION ALL ".join(
            (
                _extreme("most_expensive", "avg_entry_price", "DESC"),
                _extreme("cheapest", "avg_entry_price", "ASC"),
                _extreme("highest_free_share", "free_tier_pct", "DESC"),
                _extreme("lowest_free_share", "free_tier_pct", "ASC"),
            )
        ),
    ),
    "stat_free_share": _over(
        "mart",
        query=f"""
SELECT {_up("100 * avg(CAST(has_free_tier AS INTEGER))", 1)} AS free_tier_pct FROM mart""",
    ),
    "stat_price_rating_corr": _correlation("entry_price", "overall_rating"),
    "stat_attribute_price_corr": _correlation("feature_count", "entry_price"),
    "stat_rating_anova": _anova(),
    "stat_price_histogram": _over(
        "mart",
        query="""
SELECT bin, lo + bin * width AS lo, lo + (bin + 1) * width AS hi,
       (SELECT count(*) FROM mart
        WHERE price_comparable AND entry_price IS NOT NULL
          AND least(CAST(floor((entry_price - lo) / width) AS BIGINT), 29) = bin) AS count
FROM range(0, 30) bins(bin),
     (SELECT min(entry_price) AS lo, (max(entry_price) - min(entry_price)) / 30 AS width
      FROM mart WHERE price_comparable) ORDER BY bin""",
    ),
    "stat_price_rating_line": _over(
        "paired",
        query=f"""
SELECT {_up("regr_slope(overall_rating, entry_price)", 6)} AS slope,
       {_up("regr_intercept(overall_rating, entry_price)", 6)} AS intercept,
       {_up("regr_r2(overall_rating, entry_price)", 6)} AS r2 FROM paired""",
    ),
    "value_top5": _over(
        "paired",
        query="""
SELECT name, category_name, overall_rating, entry_price, overall_rating / entry_price AS value_score
FROM paired ORDER BY value_score DESC, entity_id LIMIT 5""",
    ),
    "billing_share": _over(
        "enriched",
        query=f"""
SELECT billing_model, count(*) AS plan_count,
       {_even(_pct("count(*)", "(SELECT count(billing_model) FROM enriched)"), 1)} AS pct
FROM enriched WHERE billing_model IS NOT NULL GROUP BY billing_model ORDER BY plan_count DESC""",
    ),
    "entity_board": _over(
        "mart",
        query="""
SELECT entity_id, name, category_slug, category_name, overall_rating, g2_rating, capterra_rating,
       founded_year, hq_location, has_free_tier, has_free_trial, has_custom_pricing,
       price_comparable, entry_price, max_price_monthly, plan_count, feature_count, website_url,
       CASE WHEN price_comparable THEN entry_price END AS entry_price_comparable FROM mart""",
    ),
    "offer_board": _over(
        "enriched",
        query="""
SELECT offer_id, product_name, plan_name, price_monthly, price_annual, billing_model FROM enriched""",
    ),
    "category_board": _over(
        "mart",
        query=f"""
SELECT category_name, count(*) AS product_count, {_up("avg(overall_rating)", 2)} AS avg_rating,
       {_up("avg(entry_price) FILTER (WHERE price_comparable)", 2)} AS avg_entry_price,
       count(*) FILTER (WHERE has_free_tier) AS free_tier_count,
       {_up(_pct("count(*) FILTER (WHERE has_free_tier)", "count(*)"), 1)} AS free_tier_pct,
       {_up("avg(feature_count)", 2)} AS avg_feature_count
FROM mart WHERE category_name IS NOT NULL GROUP BY category_name ORDER BY category_name""",
    ),
    "billing_board": _over(
        "offer",
        query=f"""
SELECT m AS billing_model,
       (SELECT count(*) FROM offer WHERE billing_model = m) AS plan_count,
       {_up(_pct("(SELECT count(*) FROM offer WHERE billing_model = m)",
                 f"(SELECT count(*) FROM offer WHERE billing_model IN ({_listed(b.BILLING_MODELS)}))"),
            1)} AS pct_of_plans
FROM (SELECT unnest([{_listed(b.BILLING_MODELS)}]) AS m)""",
    ),
    "kpi_board": _over(
        "mart",
        query=f""",
kpi AS (SELECT count(name) AS total_products, count(DISTINCT category_name) AS categories,
               {_up("median(entry_price) FILTER (WHERE price_comparable)", 2)} AS median_entry_price,
               {_up(_pct("count(*) FILTER (WHERE has_free_tier)", "count(name)"), 1)} AS free_tier_pct
        FROM mart)
SELECT *, printf('$%.2f/mo', median_entry_price) AS median_entry_price_text,
       regexp_replace(CAST(free_tier_pct AS VARCHAR), '\\.0$', '') || '%' AS free_tier_pct_text
FROM kpi""",
    ).replace(")\n,\n", "),\n"),
}

ORACLES |= {
    "price_changes": _over(
        "logged",
        query=f"""
        SELECT entity_id, plan_name, recorded_date, previous_date, old_price, price AS new_price,
               {_up(_pct("price - old_price", "old_price"), 2)} AS change_pct
        FROM logged WHERE previous_date IS NOT NULL AND price IS DISTINCT FROM old_price""",
    ),
    "price_alerts": _over(
        "logged",
        query=f"""
        SELECT entity_id, plan_name, recorded_date, previous_date, old_price, price AS new_price,
               {_up(_pct("price - old_price", "old_price"), 2)} AS change_pct
        FROM logged WHERE previous_date IS NOT NULL AND price IS DISTINCT FROM old_price
             AND recorded_date <= (SELECT max(recorded_date) FROM price_log) - INTERVAL {b.ALERT_DELAY}""",
    ),
    "price_periods": _over(
        "logged",
        query="""
        SELECT entity_id, plan_name, price, recorded_date AS valid_from,
               lead(recorded_date) OVER w AS valid_to,
               CAST(lead(recorded_date) OVER w - recorded_date AS INTEGER) AS days
        FROM logged WHERE previous_date IS NULL OR price IS DISTINCT FROM old_price
        WINDOW w AS (PARTITION BY entity_id, plan_name ORDER BY recorded_date)""",
    ),
    "price_on_dates": _over(
        "daily",
        query=f"""
        SELECT k.entity_id, k.plan_name, k.as_of, p.price, p.recorded_date
        FROM (SELECT entity_id, plan_name, coalesce(plan_name, '?') AS plan, as_of
              FROM (SELECT DISTINCT entity_id, plan_name FROM price_log),
                   (VALUES {", ".join(f"(DATE '{d}')" for d in b.REPORT_DATES)}) dates(as_of)) k
        ASOF LEFT JOIN (SELECT *, coalesce(plan_name, '?') AS plan FROM daily) p
        ON k.entity_id = p.entity_id AND k.plan = p.plan AND k.as_of >= p.recorded_date""",
    ),
    "price_by_month": _over("monthly", query="SELECT * FROM monthly"),
    "price_trends": _over(
        "monthly",
        query=f"""
        SELECT entity_id, plan_name, months,
               CASE WHEN months > 1 THEN {_up("slope", 6)} END AS slope_per_month, first_price, last_price,
               CASE WHEN months > 1 THEN {_up(_pct("last_price - first_price", "first_price"), 2)} END AS change_pct
        FROM (SELECT entity_id, plan_name, count(*) AS months,
                     CASE WHEN count(*) > 1 THEN regr_slope(price, year(month) * 12 + month(month)) END AS slope,
                     arg_min(price, month) AS first_price, arg_max(price, month) AS last_price
              FROM monthly WHERE price IS NOT NULL GROUP BY entity_id, plan_name)""",
    ),
}

ORACLES |= {
    "offer_highlights": _over(
        "highlight",
        query="SELECT offer_id, entity_id, plan_name, CAST(place AS INTEGER) AS position, highlight FROM highlight",
    ),
    "highlight_counts": _over(
        "highlight",
        query=f"""
        SELECT highlight, count(DISTINCT offer_id) AS offer_count, count(DISTINCT entity_id) AS entity_count,
               {_up("avg(price_monthly)", 2)} AS avg_monthly_price
        FROM (SELECT DISTINCT highlight, offer_id, entity_id, price_monthly FROM highlight) GROUP BY highlight""",
    ),
    "dq_highlight_format": _over(
        "listing",
        query=f"""
        SELECT status AS highlight_status, count(*) AS offer_count,
               {_even(_pct("count(*)", "(SELECT count(*) FROM listing)"), 1)} AS pct
        FROM listing GROUP BY status""",
    ),
}

ORACLES |= {
    "market_export": _over(
        "placed",
        query="""
        SELECT name AS tool_name, category_slug AS category, vertical, has_free_tier AS free_plan,
               CASE WHEN price_comparable THEN entry_price END AS starting_price_usd,
               CASE WHEN price_comparable THEN max_price_monthly END AS highest_plan_price_usd,
               CAST(coalesce(plan_count, 0) AS INTEGER) AS plan_count, overall_rating AS rating,
               CAST(feature_count AS INTEGER) AS features_count, website_url AS website
        FROM placed""",
    ),
    "benchmark_by_vertical": _over(
        "placed",
        query=f"""
        SELECT CASE e.grouping_id WHEN 0 THEN 'category' WHEN 1 THEN 'vertical' ELSE 'all' END AS level,
               CAST(e.grouping_id AS INTEGER) AS grouping_id, e.vertical, e.category, tool_count, avg_rating,
               {_even("p.median", 2)} AS median_price, free_plan_pct
        FROM (SELECT grouping_id(vertical, category_slug) AS grouping_id, vertical, category_slug AS category,
                     count(*) AS tool_count, {_even("avg(overall_rating)", 2)} AS avg_rating,
                     CAST({_even(_pct("count(*) FILTER (WHERE has_free_tier)", "count(*)"), 0)} AS INTEGER) AS free_plan_pct
              FROM placed WHERE category_slug IS NOT NULL
              GROUP BY GROUPING SETS ((vertical, category_slug), (vertical), ())) e
        LEFT JOIN (SELECT grouping_id(vertical, category_slug) AS grouping_id, vertical, category_slug AS category,
                          median(price_monthly) AS median
                   FROM placed JOIN offer USING (entity_id) WHERE category_slug IS NOT NULL AND price_monthly > 0
                   GROUP BY GROUPING SETS ((vertical, category_slug), (vertical), ())) p
        ON e.grouping_id = p.grouping_id AND e.vertical IS NOT DISTINCT FROM p.vertical
           AND e.category IS NOT DISTINCT FROM p.category""",
    ),
}

# Estimates are random within their error: the oracle says that each is near, and what it is an estimate of.
ORACLES |= {
    "estimated_median_errors": _over(
        "mart",
        query="""
        SELECT category_slug, count(*) AS prices, TRUE AS is_near
        FROM mart WHERE category_slug IS NOT NULL AND price_comparable AND entry_price IS NOT NULL
        GROUP BY category_slug""",
    ),
    "estimated_count_errors": _over(
        "mart",
        query="""
        SELECT category_slug, count(*) AS exact, TRUE AS is_near
        FROM mart WHERE category_slug IS NOT NULL GROUP BY category_slug""",
    ),
}

_PART_KEYS = """
    SELECT p_partkey AS part_id, lower(p_name) || '-' || p_brand AS slug,
           p_type || '-' || CAST(p_size AS VARCHAR) AS kind FROM part"""

ORACLES |= {
    # One part after the other: a row of this recursion is a part, with the keys that are taken before it.
    "load_two_keys": f"""
        WITH RECURSIVE parts AS ({_PART_KEYS}),
        numbered AS (SELECT *, row_number() OVER (ORDER BY part_id) AS n FROM parts),
        loaded AS (
            SELECT n, part_id, slug, kind, TRUE AS stays, [slug] AS slugs, [kind] AS kinds FROM numbered WHERE n = 1
            UNION ALL
            SELECT p.n, p.part_id, p.slug, p.kind,
                   NOT list_contains(l.slugs, p.slug) AND NOT list_contains(l.kinds, p.kind),
                   CASE WHEN NOT list_contains(l.slugs, p.slug) AND NOT list_contains(l.kinds, p.kind)
                        THEN list_append(l.slugs, p.slug) ELSE l.slugs END,
                   CASE WHEN NOT list_contains(l.slugs, p.slug) AND NOT list_contains(l.kinds, p.kind)
                        THEN list_append(l.kinds, p.kind) ELSE l.kinds END
            FROM loaded l JOIN numbered p ON p.n = l.n + 1)
        SELECT part_id, slug, kind FROM loaded WHERE stays""",
    "load_into_stored": f"""
        WITH parts AS ({_PART_KEYS})
        SELECT min(part_id) AS part_id, slug FROM parts
        WHERE part_id % 3 <> 0 AND slug NOT IN (SELECT slug FROM parts WHERE part_id % 3 = 0)
        GROUP BY slug""",
    "csv_round_trip": ORACLES["entity_mart"],
}
