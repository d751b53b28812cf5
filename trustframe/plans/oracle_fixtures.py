"""DuckDB-dialect SQL of the derived fixture tables (oracle side).

Each entry is a CTE body computed from the pre-registered Parquet views;
``with_fixtures`` prepends the ones a query needs, with dependencies.
"""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_li": ((), """SELECT l_orderkey, COUNT(*) AS li_n, SUM(l_quantity) AS li_qty
        FROM lineitem GROUP BY l_orderkey"""),
    "fx_o": (("fx_li",), """SELECT o_custkey, COUNT(*) AS n_ord,
            SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS n_f,
            SUM(COALESCE(li_n, 0)) AS n_li, SUM(COALESCE(li_qty, 0)) AS qty,
            MIN(CAST(o_orderdate AS DATE)) AS first_day
        FROM orders LEFT JOIN fx_li ON l_orderkey = o_orderkey GROUP BY o_custkey"""),
    "accounts": (("fx_o",), """SELECT c_custkey AS id,
            CAST(COALESCE(n_ord, 0) AS DOUBLE) AS followers_count,
            CAST(c_nationkey AS DOUBLE) AS following_count,
            CAST(COALESCE(n_li, 0) AS DOUBLE) AS tweet_count,
            CAST(COALESCE(n_f, 0) AS DOUBLE) AS listed_count,
            CAST(COALESCE(qty, 0) AS DOUBLE) AS favourites_count,
            CAST(COALESCE(DATEDIFF('day', first_day, DATE '2002-01-01'), 0) AS DOUBLE) AS account_age_days,
            CASE WHEN c_custkey % 5 <> 0 THEN 1 ELSE 0 END AS has_profile_image,
            CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS default_profile,
            CASE WHEN c_mktsegment <> 'MACHINERY' THEN 1 ELSE 0 END AS has_description,
            CASE WHEN c_acctbal > 9000 THEN 1 ELSE 0 END AS verified,
            CASE WHEN n_regionkey <> 0 THEN 1 ELSE 0 END AS has_location,
            CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS has_url,
            CASE WHEN c_acctbal < 2000 THEN 1 ELSE 0 END AS label
        FROM customer JOIN nation ON n_nationkey = c_nationkey
        LEFT JOIN fx_o ON o_custkey = c_custkey"""),
    "scored": (("accounts",), """SELECT *,
            CAST(id * 7919 % 1000 AS DOUBLE) / 1000 AS p,
            CASE WHEN id % 4 = 0 THEN NULL ELSE CAST(id * 104729 % 1000 AS DOUBLE) / 1000 END AS img
        FROM accounts"""),
    "label_score": (("accounts",), """SELECT id, label, CAST(id * 7919 % 1000 AS DOUBLE) / 1000 AS score
        FROM accounts"""),
    "api_calls": ((), """SELECT event_id AS id, ts AS timestamp,
            CASE WHEN event_type IN ('signup','purchase') THEN 'analyze_profile_image' ELSE 'analyze_user' END AS endpoint,
            value AS response_time_ms,
            CASE WHEN event_type IN ('view','click') THEN CAST(event_id * 7919 % 1000 AS DOUBLE) / 1000 END AS bot_probability,
            CASE WHEN event_type IN ('signup','purchase') THEN CAST(event_id * 104729 % 1000 AS DOUBLE) / 1000 END AS image_risk_score,
            CASE WHEN event_type = 'error' THEN NULL
                 WHEN event_type IN ('view','click') THEN CASE WHEN event_id * 7919 % 1000 >= 600 THEN 'High'
                                                               WHEN event_id * 7919 % 1000 >= 300 THEN 'Medium' ELSE 'Low' END
                 ELSE CASE WHEN event_id * 104729 % 1000 < 330 THEN 'low'
                           WHEN event_id * 104729 % 1000 < 660 THEN 'medium' ELSE 'high' END END AS risk_level,
            CASE WHEN event_type IN ('view','click') THEN CASE WHEN event_id * 7919 % 1000 >= 300 THEN 1 ELSE 0 END END AS is_bot,
            CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS error
        FROM events"""),
    "extension_pings": ((), """SELECT event_id AS id, ts AS timestamp,
            CASE WHEN user_id % 10 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS extension_id,
            CASE WHEN user_id % 2 = 0 THEN '1.0' ELSE '1.1' END AS version
        FROM events WHERE event_type = 'signup'"""),
    "image_signals": ((), """SELECT doc_id AS image_id, 60 + doc_id * 7 % 700 AS width, 60 + doc_id * 13 % 500 AS height,
            CAST(doc_id * 31 % 400 AS DOUBLE) AS laplacian_variance,
            CAST(doc_id * 17 % 150 AS DOUBLE) / 1000 AS compression_proxy,
            CAST(doc_id * 29 % 400 AS DOUBLE) / 1000 AS edge_density,
            CAST(doc_id * 37 % 6000 AS DOUBLE) AS hsv_variance
        FROM documents"""),
    "face_detections": ((), """SELECT doc_id AS image_id, k AS det_id,
            CAST((doc_id * 3 + k * 19) % 80 AS DOUBLE) / 100 - 0.05 AS xmin,
            CAST((doc_id * 5 + k * 23) % 80 AS DOUBLE) / 100 - 0.05 AS ymin,
            CAST((doc_id + k * 11) % 50 AS DOUBLE) / 100 AS box_w,
            CAST((doc_id * 2 + k * 7) % 50 AS DOUBLE) / 100 AS box_h,
            CAST((doc_id * 11 + k * 41) % 100 AS DOUBLE) / 100 AS score
        FROM documents CROSS JOIN (VALUES (0),(1),(2),(3)) AS t(k) WHERE k < doc_id % 5"""),
    "scraped_urls": ((), """SELECT page_id,
            CASE WHEN page_id % 3 = 0 THEN CONCAT('https://site.example/User', CAST(page_id AS VARCHAR))
                 WHEN page_id % 3 = 1 THEN 'https://site.example/Home' ELSE url END AS url
        FROM pages"""),
    "raw_labels": ((), """SELECT c_custkey AS id, CASE WHEN c_acctbal < 2000 THEN 'bot'
            WHEN c_mktsegment = 'AUTOMOBILE' THEN 'others' ELSE 'human' END AS label
        FROM customer WHERE c_acctbal >= 0"""),
    "splits": ((), """SELECT c_custkey AS id, CASE WHEN c_nationkey < 15 THEN 'train'
            WHEN c_nationkey < 20 THEN 'val' ELSE 'test' END AS split FROM customer"""),
    "requests": (("accounts",), """SELECT id, followers_count - 3 AS followers_count, following_count,
            CASE WHEN id % 13 = 0 THEN NULL ELSE tweet_count END AS tweet_count, listed_count,
            account_age_days - 300 AS account_age_days, has_profile_image, has_description, verified,
            has_location, has_url, CASE WHEN id % 7 = 0 THEN NULL ELSE favourites_count END AS favourites_count,
            CASE WHEN id % 11 = 0 THEN NULL ELSE default_profile END AS default_profile FROM accounts"""),
    "profile_text": ((), """SELECT c_custkey AS id,
            CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN concat('  ', chr(10), ' ') ELSE c_name END AS description,
            CASE WHEN n_regionkey = 0 THEN '' ELSE n_name END AS location,
            CASE WHEN c_acctbal < 0 THEN NULL ELSE concat('https://example.com/', CAST(c_custkey AS VARCHAR)) END AS url,
            CASE WHEN c_custkey % 5 = 0 THEN strftime(ts, '%a %b %d %H:%M:%S +0000 %Y')
                 WHEN c_custkey % 5 = 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S+00:00')
                 WHEN c_custkey % 5 = 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
                 WHEN c_custkey % 5 = 3 THEN '' ELSE 'not a date' END AS created_at
        FROM (SELECT *, make_timestamp(2006 + c_custkey % 20, 1 + c_custkey % 12, 1 + c_custkey % 28,
                                       c_custkey % 24, c_custkey % 60, CAST(c_nationkey AS DOUBLE)) AS ts
              FROM customer JOIN nation ON n_nationkey = c_nationkey) c"""),
    "scraped_profiles": ((), """SELECT c_custkey AS id,
            [CASE WHEN ((c_custkey + 0) % 8) = 0 THEN concat(CAST(c_nationkey AS VARCHAR), '.', CAST(c_custkey % 10 AS VARCHAR), 'K') WHEN ((c_custkey + 0) % 8) = 1 THEN concat(CAST(c_nationkey AS VARCHAR), 'M') WHEN ((c_custkey + 0) % 8) = 2 THEN concat(CAST(c_custkey AS VARCHAR), ',', lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0')) WHEN ((c_custkey + 0) % 8) = 3 THEN '1.2.3' WHEN ((c_custkey + 0) % 8) = 4 THEN concat(CAST(c_custkey % 50 AS VARCHAR), ' k') WHEN ((c_custkey + 0) % 8) = 5 THEN '' WHEN ((c_custkey + 0) % 8) = 6 THEN c_mktsegment ELSE concat(CAST(c_nationkey AS VARCHAR), '.4B') END, CASE WHEN ((c_custkey + 3) % 8) = 0 THEN concat(CAST(c_nationkey AS VARCHAR), '.', CAST(c_custkey % 10 AS VARCHAR), 'K') WHEN ((c_custkey + 3) % 8) = 1 THEN concat(CAST(c_nationkey AS VARCHAR), 'M') WHEN ((c_custkey + 3) % 8) = 2 THEN concat(CAST(c_custkey AS VARCHAR), ',', lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0')) WHEN ((c_custkey + 3) % 8) = 3 THEN '1.2.3' WHEN ((c_custkey + 3) % 8) = 4 THEN concat(CAST(c_custkey % 50 AS VARCHAR), ' k') WHEN ((c_custkey + 3) % 8) = 5 THEN '' WHEN ((c_custkey + 3) % 8) = 6 THEN c_mktsegment ELSE concat(CAST(c_nationkey AS VARCHAR), '.4B') END, CASE WHEN ((c_custkey + 5) % 8) = 0 THEN concat(CAST(c_nationkey AS VARCHAR), '.', CAST(c_custkey % 10 AS VARCHAR), 'K') WHEN ((c_custkey + 5) % 8) = 1 THEN concat(CAST(c_nationkey AS VARCHAR), 'M') WHEN ((c_custkey + 5) % 8) = 2 THEN concat(CAST(c_custkey AS VARCHAR), ',', lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0')) WHEN ((c_custkey + 5) % 8) = 3 THEN '1.2.3' WHEN ((c_custkey + 5) % 8) = 4 THEN concat(CAST(c_custkey % 50 AS VARCHAR), ' k') WHEN ((c_custkey + 5) % 8) = 5 THEN '' WHEN ((c_custkey + 5) % 8) = 6 THEN c_mktsegment ELSE concat(CAST(c_nationkey AS VARCHAR), '.4B') END] AS followers_texts,
            [CASE WHEN ((c_custkey + 1) % 8) = 0 THEN concat(CAST(c_nationkey AS VARCHAR), '.', CAST(c_custkey % 10 AS VARCHAR), 'K') WHEN ((c_custkey + 1) % 8) = 1 THEN concat(CAST(c_nationkey AS VARCHAR), 'M') WHEN ((c_custkey + 1) % 8) = 2 THEN concat(CAST(c_custkey AS VARCHAR), ',', lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0')) WHEN ((c_custkey + 1) % 8) = 3 THEN '1.2.3' WHEN ((c_custkey + 1) % 8) = 4 THEN concat(CAST(c_custkey % 50 AS VARCHAR), ' k') WHEN ((c_custkey + 1) % 8) = 5 THEN '' WHEN ((c_custkey + 1) % 8) = 6 THEN c_mktsegment ELSE concat(CAST(c_nationkey AS VARCHAR), '.4B') END, CASE WHEN ((c_custkey + 2) % 8) = 0 THEN concat(CAST(c_nationkey AS VARCHAR), '.', CAST(c_custkey % 10 AS VARCHAR), 'K') WHEN ((c_custkey + 2) % 8) = 1 THEN concat(CAST(c_nationkey AS VARCHAR), 'M') WHEN ((c_custkey + 2) % 8) = 2 THEN concat(CAST(c_custkey AS VARCHAR), ',', lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0')) WHEN ((c_custkey + 2) % 8) = 3 THEN '1.2.3' WHEN ((c_custkey + 2) % 8) = 4 THEN concat(CAST(c_custkey % 50 AS VARCHAR), ' k') WHEN ((c_custkey + 2) % 8) = 5 THEN '' WHEN ((c_custkey + 2) % 8) = 6 THEN c_mktsegment ELSE concat(CAST(c_nationkey AS VARCHAR), '.4B') END] AS following_texts,
            CASE WHEN c_custkey % 6 = 0 THEN concat('Joined ', ['January','February','March','April','May','June','July','August','September','October','November','December'][c_custkey % 12 + 1], ' ', CAST(2006 + c_custkey % 18 AS VARCHAR))
                 WHEN c_custkey % 6 = 1 THEN concat('joined ', substr(['January','February','March','April','May','June','July','August','September','October','November','December'][c_custkey % 12 + 1], 1, 3), ' ', CAST(2006 + c_custkey % 18 AS VARCHAR))
                 WHEN c_custkey % 6 = 3 THEN concat('Joined Foo ', CAST(2006 + c_custkey % 18 AS VARCHAR))
                 WHEN c_custkey % 6 = 4 THEN concat('Joined ', lower(['January','February','March','April','May','June','July','August','September','October','November','December'][c_custkey % 12 + 1]), ' ', CAST(2006 + c_custkey % 18 AS VARCHAR))
                 WHEN c_custkey % 6 = 5 THEN concat('Member since ', CAST(2006 + c_custkey % 18 AS VARCHAR)) END AS join_text,
            [concat(c_name, ' profile'),
             CASE WHEN c_custkey % 4 = 0 THEN concat(CAST(c_custkey AS VARCHAR), ' posts')
                  WHEN c_custkey % 4 = 1 THEN concat(CAST(c_nationkey AS VARCHAR), '.5K Posts')
                  WHEN c_custkey % 4 = 2 THEN '0 posts'
                  ELSE concat(CAST(c_custkey % 7 AS VARCHAR), ',100 posts') END,
             concat(CAST(c_custkey * 3 AS VARCHAR), ' post')] AS aria_labels,
            CASE WHEN c_custkey % 4 = 0 THEN concat('https://pbs.twimg.com/profile_images/', CAST(c_custkey AS VARCHAR), '/a_normal.jpg')
                 WHEN c_custkey % 4 = 1 THEN concat('https://pbs.twimg.com/profile_images/', CAST(c_custkey AS VARCHAR), '/x_bigger_normal.png')
                 WHEN c_custkey % 4 = 2 THEN 'https://abs.twimg.com/sticky/default_profile_images/default_profile_mini.png' END AS avatar_url,
            CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN concat('  ', chr(10), ' ') ELSE c_name END AS bio,
            CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_nationkey AS VARCHAR) END AS location,
            CASE WHEN c_acctbal < 0 THEN NULL ELSE 'example.com' END AS url,
            CASE WHEN c_custkey % 9 = 0 THEN 'badge' END AS badge,
            CASE WHEN c_custkey % 2 = 0 THEN 'banner' END AS banner
        FROM customer"""),
}


def with_fixtures(names, body: str) -> str:
    """``WITH <needed fixture CTEs> <body>``; ``body`` may start with ``, x AS (...)``."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    ctes = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    body = body.strip()
    if not order:
        return body
    if body.startswith(","):
        return f"WITH {ctes}{body}"
    return f"WITH {ctes}\n{body}"
