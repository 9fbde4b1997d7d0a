"""The marketing views as DuckDB CTEs, stated independently of the DataFrame code."""

VIEWS = """
ev0 AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events),
ev AS (
  SELECT event_id, user_id, ts, event_type, k, value, CAST(user_id AS VARCHAR) || ':' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id,
    CASE k % 6 WHEN 0 THEN 'google' WHEN 1 THEN 'meta' WHEN 2 THEN 'tiktok' WHEN 3 THEN 'microsoft' WHEN 4 THEN 'email' END AS source,
    CASE WHEN k % 6 IN (0, 3) THEN 'cpc' WHEN k % 6 IN (1, 2) THEN 'paid_social' WHEN k % 6 = 4 THEN 'email' END AS medium,
    CASE WHEN k % 6 < 5 THEN 'c' || CAST(k % 10 AS VARCHAR) END AS campaign, CAST(NULL AS VARCHAR) AS content, CAST(NULL AS VARCHAR) AS term,
    CASE WHEN k % 6 IN (0, 1) AND k % 4 = 0 THEN CASE WHEN k % 6 = 0 THEN 'gclid' ELSE 'fbclid' END END AS click_type,
    CASE WHEN k % 6 IN (0, 1) AND k % 4 = 0 THEN 'clk' || CAST(event_id AS VARCHAR) END AS click_value,
    't' || CAST(event_id % 500 AS VARCHAR) AS checkout_token, 'c' || CAST(event_id % 300 AS VARCHAR) AS cart_token
  FROM ev0),
touch AS (SELECT * FROM ev WHERE event_type IN ('view', 'click', 'signup')),
firsts AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS rn, min(ts) OVER (PARTITION BY session_id) AS first_seen,
  max(ts) OVER (PARTITION BY session_id) AS last_seen, count(*) OVER (PARTITION BY session_id) AS touches FROM touch),
sess AS (SELECT session_id, user_id, first_seen, last_seen, touches, event_id, source, medium, campaign, content, term, click_type, click_value FROM firsts WHERE rn = 1),
ord AS (
  SELECT event_id AS order_id, user_id, ts, CAST(floor(value * 100 + 0.5) AS BIGINT) AS cents, CASE WHEN k % 7 = 0 THEN 'pos' ELSE 'web' END AS source_name,
    checkout_token, cart_token, session_id, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles' AS DATE) AS order_date
  FROM ev WHERE event_type = 'purchase'),
spend AS (
  SELECT CAST(DATE '2024-01-01' + CAST(dayofyear(l_shipdate) % 30 AS INTEGER) AS DATE) AS report_date, l_suppkey % 5 AS connection_id, 'c' || CAST(l_partkey % 40 AS VARCHAR) AS campaign_id,
    'e' || CAST(l_partkey % 400 AS VARCHAR) AS entity_id, CASE WHEN l_returnflag = 'A' THEN 'google' ELSE 'meta' END AS platform,
    CASE WHEN l_linenumber > 1 THEN 'creative' ELSE 'campaign' END AS granularity, CASE WHEN l_returnflag = 'A' THEN 'google' ELSE 'meta' END AS source,
    CASE WHEN l_returnflag = 'A' THEN 'cpc' ELSE 'paid_social' END AS medium, 'c' || CAST(l_partkey % 40 AS VARCHAR) AS campaign,
    CAST(floor(l_extendedprice * l_discount * 100 + 0.5) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) AS clicks, CAST(l_quantity AS BIGINT) * 20 AS impressions
  FROM lineitem),
hist AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS ts, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS cents, o_orderstatus AS status, o_orderpriority AS priority FROM orders)
"""

ATTRIBUTION = """
landing AS (SELECT o.order_id, s.session_id, s.event_id, s.first_seen AS ts, s.source, s.medium, s.campaign, s.content, s.term, s.click_type, s.click_value, 'landing_session_id' AS evidence
  FROM ord o JOIN sess s USING (session_id) WHERE s.first_seen <= o.ts),
tok AS (
  SELECT * FROM (SELECT o.order_id, t.session_id, t.event_id, t.ts, t.source, t.medium, t.campaign, t.content, t.term, t.click_type, t.click_value, 'checkout_token' AS evidence,
      row_number() OVER (PARTITION BY o.order_id ORDER BY t.ts DESC, t.event_id DESC) AS rn
    FROM ord o JOIN touch t ON o.checkout_token = t.checkout_token AND t.ts <= o.ts AND t.ts >= o.ts - INTERVAL 7 DAY) WHERE rn = 1),
cart AS (
  SELECT * FROM (SELECT o.order_id, t.session_id, t.event_id, t.ts, t.source, t.medium, t.campaign, t.content, t.term, t.click_type, t.click_value, 'cart_token' AS evidence,
      row_number() OVER (PARTITION BY o.order_id ORDER BY t.ts DESC, t.event_id DESC) AS rn
    FROM ord o JOIN touch t ON o.cart_token = t.cart_token AND t.ts <= o.ts AND t.ts >= o.ts - INTERVAL 7 DAY) WHERE rn = 1),
ident AS (SELECT o.order_id, s.session_id, s.event_id, s.first_seen AS ts, s.source, s.medium, s.campaign, s.content, s.term, s.click_type, s.click_value, 'customer_identity' AS evidence
  FROM ord o JOIN sess s ON o.user_id = s.user_id AND s.first_seen <= o.ts AND s.first_seen >= o.ts - INTERVAL 7 DAY),
cand AS (
  SELECT *, CASE evidence WHEN 'landing_session_id' THEN 1 WHEN 'checkout_token' THEN 2 WHEN 'cart_token' THEN 3 ELSE 4 END AS prec,
    coalesce(source, '') = '' AND coalesce(medium, '') = '' AND coalesce(campaign, '') = '' AND coalesce(click_value, '') = '' AS is_direct, click_value IS NOT NULL AS has_click
  FROM (SELECT * FROM landing UNION ALL SELECT * EXCLUDE (rn) FROM tok UNION ALL SELECT * EXCLUDE (rn) FROM cart UNION ALL SELECT * FROM ident)),
dedup AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY order_id, session_id ORDER BY prec, ts DESC, has_click DESC, event_id) AS rn FROM cand) WHERE rn = 1),
line AS (
  SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY ts, prec, has_click DESC, session_id) - 1 AS position, count(*) OVER (PARTITION BY order_id) AS n,
    row_number() OVER (PARTITION BY order_id ORDER BY is_direct, ts DESC, prec, has_click DESC, session_id) = 1 AS is_winner FROM dedup),
journey AS (
  SELECT o.order_id, o.cents, o.ts AS order_ts, o.order_date, o.source_name, o.user_id, l.session_id, coalesce(l.ts, o.ts) AS ts, l.source, l.medium, l.campaign, l.content, l.term, l.click_value,
    coalesce(l.evidence, 'unattributed') AS evidence, coalesce(l.is_direct, TRUE) AS is_direct, coalesce(l.position, 0) AS position, coalesce(l.n, 1) AS n, coalesce(l.is_winner, TRUE) AS is_winner
  FROM ord o LEFT JOIN line l USING (order_id)),
raww AS (
  SELECT j.*, m.model, CASE m.model
      WHEN 'first_touch' THEN CASE WHEN position = 0 THEN 1.0 ELSE 0.0 END::DOUBLE
      WHEN 'last_touch' THEN CASE WHEN is_winner THEN 1.0 ELSE 0.0 END::DOUBLE
      WHEN 'linear' THEN 1.0::DOUBLE
      WHEN 'time_decay' THEN pow(0.5::DOUBLE, greatest(datediff_s, 0) / 604800.0::DOUBLE)
      WHEN 'position_based' THEN CASE WHEN n <= 2 THEN 1.0::DOUBLE WHEN position = 0 OR position = n - 1 THEN 0.4::DOUBLE ELSE (1.0::DOUBLE - 0.4::DOUBLE - 0.4::DOUBLE) / greatest(n - 2, 1) END
      ELSE CASE WHEN n = 1 THEN 1.0::DOUBLE WHEN position = 0 THEN 0.3::DOUBLE WHEN position = n - 1 THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END
        * CASE WHEN click_value IS NOT NULL THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN is_direct THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END END AS raw
  FROM (SELECT *, floor((epoch_us(order_ts) - epoch_us(ts)) / 1000000) AS datediff_s FROM journey) j
  CROSS JOIN (SELECT unnest(['first_touch', 'last_touch', 'linear', 'time_decay', 'position_based', 'rule_based_weighted']) AS model) m),
sums AS (SELECT order_id, model, list_reduce(list(raw ORDER BY position), lambda a, b: a + b) AS total FROM raww GROUP BY ALL),
wts AS (SELECT r.*, r.raw / s.total AS weight, r.cents * (r.raw / s.total) AS exact FROM raww r JOIN sums s USING (order_id, model)),
flo AS (SELECT *, CAST(floor(exact) AS BIGINT) AS fl FROM wts),
rem AS (SELECT *, cents - sum(fl) OVER (PARTITION BY order_id, model) AS leftover, row_number() OVER (PARTITION BY order_id, model ORDER BY exact - fl DESC, position) AS rr FROM flo),
alloc AS (SELECT *, fl + CASE WHEN rr <= leftover THEN 1 ELSE 0 END AS credit_cents FROM rem),
cred AS (SELECT *, row_number() OVER (PARTITION BY order_id, model ORDER BY credit_cents DESC, position) = 1 AS is_primary FROM alloc)
"""

CUBE = """
ranks AS (SELECT order_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, order_id) AS customer_rank FROM ord WHERE source_name = 'web'),
models AS (SELECT unnest(['first_touch', 'last_touch', 'linear', 'time_decay', 'position_based', 'rule_based_weighted']) AS model),
lone AS (SELECT * FROM spend c WHERE platform = 'google' AND granularity = 'campaign' AND NOT EXISTS (SELECT 1 FROM spend g WHERE g.platform = 'google' AND g.granularity = 'creative'
  AND g.report_date = c.report_date AND g.connection_id = c.connection_id AND g.campaign_id IS NOT DISTINCT FROM c.campaign_id)),
counted AS (SELECT * FROM spend WHERE granularity = 'creative' UNION ALL SELECT * FROM lone),
parts AS (
  SELECT CAST((first_seen AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles' AS DATE) AS metric_date, model, coalesce(source, 'unknown') AS source, coalesce(medium, 'unknown') AS medium,
    coalesce(campaign, 'unknown') AS campaign, 'unknown' AS content, 'unknown' AS term, count(*) AS visits, 0 AS orders_e8, 0 AS revenue_cents, 0 AS spend_cents, 0 AS impressions, 0 AS clicks,
    0 AS new_orders_e8, 0 AS returning_orders_e8, 0 AS new_revenue_cents, 0 AS returning_revenue_cents
  FROM sess CROSS JOIN models GROUP BY ALL
  UNION ALL
  SELECT order_date, model, coalesce(source, 'unknown'), coalesce(medium, 'unknown'), coalesce(campaign, 'unknown'), 'unknown', 'unknown', 0, sum(w), sum(credit_cents), 0, 0, 0,
    sum(CASE WHEN customer_rank = 1 THEN w ELSE 0 END), sum(CASE WHEN customer_rank > 1 THEN w ELSE 0 END), sum(CASE WHEN customer_rank = 1 THEN credit_cents ELSE 0 END), sum(CASE WHEN customer_rank > 1 THEN credit_cents ELSE 0 END)
  FROM (SELECT c.*, r.customer_rank, CAST(floor(c.weight * 100000000 + 0.5) AS BIGINT) AS w FROM cred c JOIN ranks r USING (order_id)) WHERE source_name = 'web' GROUP BY ALL
  UNION ALL
  SELECT report_date, model, source, medium, campaign, 'unknown', 'unknown', 0, 0, 0, sum(cents), sum(impressions), sum(clicks), 0, 0, 0, 0 FROM counted CROSS JOIN models GROUP BY ALL),
cube AS (
  SELECT metric_date, model, source, medium, campaign, content, term, CAST(sum(visits) AS BIGINT) AS visits, CAST(sum(orders_e8) AS BIGINT) AS orders_e8, CAST(sum(revenue_cents) AS BIGINT) AS revenue_cents,
    CAST(sum(spend_cents) AS BIGINT) AS spend_cents, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(new_orders_e8) AS BIGINT) AS new_orders_e8,
    CAST(sum(returning_orders_e8) AS BIGINT) AS returning_orders_e8, CAST(sum(new_revenue_cents) AS BIGINT) AS new_revenue_cents, CAST(sum(returning_revenue_cents) AS BIGINT) AS returning_revenue_cents
  FROM parts GROUP BY ALL)
"""


def over(select: str, *ctes: str) -> str:
    """A query over the views and further CTEs."""
    return "WITH RECURSIVE " + ",\n".join(c.strip() for c in (VIEWS, *ctes)) + "\n" + select.strip()


def over_credits(select: str) -> str:
    return over(select, ATTRIBUTION)


def over_cube(select: str) -> str:
    return over(select, ATTRIBUTION, CUBE)
