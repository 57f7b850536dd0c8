"""Shared SQL views for the check queries, in plain SQL over the given tables."""

VIEWS = {
    "ln": """SELECT l_orderkey, l_suppkey, SUM(l_quantity) AS q, COUNT(*) AS n_lines FROM lineitem GROUP BY 1, 2""",
    "games": """SELECT o.o_orderkey AS game_id, YEAR(o.o_orderdate) AS season, CAST(o.o_orderdate AS DATE) AS game_date,
 o.o_orderpriority AS league, h.l_suppkey AS home, a.l_suppkey AS away, h.q AS home_score, a.q AS away_score,
 h.q - a.q AS margin, CASE WHEN h.q > a.q THEN 1 WHEN h.q < a.q THEN 0 END AS home_win
 FROM (SELECT l_orderkey, MIN(l_suppkey) AS s1, MAX(l_suppkey) AS s2 FROM lineitem GROUP BY 1
       HAVING MIN(l_suppkey) <> MAX(l_suppkey)) p
 JOIN ln h ON h.l_orderkey = p.l_orderkey AND h.l_suppkey = CASE WHEN p.l_orderkey % 2 = 0 THEN s1 ELSE s2 END
 JOIN ln a ON a.l_orderkey = p.l_orderkey AND a.l_suppkey = CASE WHEN p.l_orderkey % 2 = 0 THEN s2 ELSE s1 END
 JOIN orders o ON o.o_orderkey = p.l_orderkey""",
    "elog": """SELECT game_id, season, game_date, league, home AS entity, away AS opponent, 1 AS is_home,
 home_score AS score, away_score AS opp_score, margin AS diff, home_win AS win FROM games
 UNION ALL SELECT game_id, season, game_date, league, away, home, 0, away_score, home_score, -margin, 1 - home_win FROM games""",
    "dim": """SELECT s_suppkey AS entity, s_name AS name, r_name AS conference, n_name AS division,
 CAST(n_nationkey + 25 AS DOUBLE) AS lat, CAST(n_nationkey * 2 - 120 AS DOUBLE) AS lon,
 CASE n_nationkey % 4 WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'America/Chicago'
  WHEN 2 THEN 'America/Denver' ELSE 'America/Los_Angeles' END AS tz
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "members": """SELECT l_orderkey AS game_id, YEAR(o_orderdate) AS season, CAST(o_orderdate AS DATE) AS game_date,
 l_suppkey AS entity, l_partkey AS member, points, ROUND(tax * 1000 + 5) AS minutes, ROUND(discount * 100) AS shots
 FROM (SELECT l_orderkey, l_suppkey, l_partkey, SUM(l_quantity) AS points, SUM(l_tax) AS tax, SUM(l_discount) AS discount
       FROM lineitem GROUP BY 1, 2, 3) m JOIN orders ON o_orderkey = l_orderkey""",
    "odds": """SELECT game_id, season, game_date, home, away, margin, home_win,
 CAST(CASE WHEN game_id % 200 < 100 THEN -(game_id % 200 * 3 + 110) ELSE game_id % 200 * 3 - 200 END AS DOUBLE) AS home_ml,
 CAST(CASE WHEN game_id % 200 < 100 THEN game_id % 200 * 3 + 100 ELSE -(game_id % 200 * 3 - 190) END AS DOUBLE) AS away_ml,
 CAST(100 - game_id % 200 AS DOUBLE) / 10e0 AS spread_line FROM games""",
    "ev": """SELECT user_id AS game_id, ts, event_id, event_type, value, CAST(ts AS DATE) AS day,
 CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 3 ELSE 0 END AS dh,
 CASE event_type WHEN 'view' THEN 1 WHEN 'error' THEN 3 ELSE 0 END AS da FROM events""",
    "sc": """SELECT *, ROW_NUMBER() OVER w AS seq, COUNT(*) OVER (PARTITION BY game_id) AS n,
 SUM(dh) OVER w AS home_score, SUM(da) OVER w AS away_score,
 SUM(dh - da) OVER (PARTITION BY game_id) AS final_margin
 FROM ev WINDOW w AS (PARTITION BY game_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
    "states": """SELECT game_id, seq, ts, day, event_id, event_type, value, n, 1 - CAST(seq AS DOUBLE) / n AS frac,
 CAST(CEIL(CAST(seq * 4 AS DOUBLE) / n) AS INT) AS period, home_score, away_score, home_score - away_score AS margin,
 final_margin, CASE WHEN final_margin > 0 THEN 1 WHEN final_margin < 0 THEN 0 END AS home_won FROM sc""",
    "imp": """SELECT *, CASE WHEN home_ml < 0 THEN -home_ml / (100e0 - home_ml) ELSE 100e0 / (home_ml + 100e0) END AS ph,
 CASE WHEN away_ml < 0 THEN -away_ml / (100e0 - away_ml) ELSE 100e0 / (away_ml + 100e0) END AS pa FROM odds""",
    "dayform": """SELECT entity, season, game_date, SUM(w) OVER d / NULLIF(SUM(g) OVER d, 0) AS form
 FROM (SELECT entity, season, game_date, CAST(SUM(win) AS DOUBLE) AS w, COUNT(win) AS g FROM elog GROUP BY 1, 2, 3) t
 WINDOW d AS (PARTITION BY entity, season ORDER BY game_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "prior": """SELECT entity, season + 1 AS season, CAST(SUM(win) AS DOUBLE) / NULLIF(COUNT(win), 0) AS prior
 FROM elog GROUP BY entity, season""",
    "pw": """SELECT i.season, i.game_id, i.game_date, i.home, i.away, i.margin, i.home_win, i.home_ml, i.away_ml, i.spread_line,
 ph / (ph + pa) AS p_market,
 GREATEST(0.02e0, LEAST(0.98e0, 0.5e0 + 0.4e0 * (COALESCE(hf.form, 0.5e0) - COALESCE(af.form, 0.5e0)))) AS p_form,
 GREATEST(0.02e0, LEAST(0.98e0, 0.5e0 + 0.3e0 * (COALESCE(hp.prior, 0.5e0) - COALESCE(ap.prior, 0.5e0)))) AS p_prior
 FROM imp i JOIN dayform hf ON hf.entity = i.home AND hf.game_date = i.game_date
 JOIN dayform af ON af.entity = i.away AND af.game_date = i.game_date
 LEFT JOIN prior hp ON hp.entity = i.home AND hp.season = i.season
 LEFT JOIN prior ap ON ap.entity = i.away AND ap.season = i.season
 WHERE i.home_win IS NOT NULL""",
    "preds": """SELECT season, game_id, game_date, home, away, margin, home_win AS y, 'form' AS model_id, p_form AS p FROM pw
 UNION ALL SELECT season, game_id, game_date, home, away, margin, home_win, 'market', p_market FROM pw
 UNION ALL SELECT season, game_id, game_date, home, away, margin, home_win, 'prior', p_prior FROM pw""",
}
NEEDS = {"games": ["ln"], "elog": ["games"], "odds": ["games"], "sc": ["ev"], "states": ["sc"], "imp": ["odds"],
         "dayform": ["elog"], "prior": ["elog"], "pw": ["imp", "dayform", "prior"], "preds": ["pw"]}


def over(views: str, body: str, **extra: str) -> str:
    """``body`` with the named views (and ``extra`` ones, in order) as common table expressions."""
    order: list[str] = []

    def need(v):
        for d in NEEDS.get(v, []):
            need(d)
        if v not in order:
            order.append(v)

    for v in views.split():
        need(v)
    parts = [f"{v} AS ({VIEWS[v]})" for v in order] + [f"{k} AS ({s})" for k, s in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def log_loss(p: str = "p", y: str = "y", eps: str = "1e-6") -> str:
    q = f"GREATEST({eps}, LEAST(1e0 - {eps}, {p}))"
    return f"(-({y} * LN({q}) + (1 - {y}) * LN(1e0 - {q})))"


def hit(p: str = "p", y: str = "y") -> str:
    return f"(CASE WHEN (CASE WHEN {p} >= 0.5e0 THEN 1 ELSE 0 END) = {y} THEN 1e0 ELSE 0e0 END)"


def wilson(k: str, n: str, sign: str) -> str:
    z = "1.959963984540054e0"
    p = f"(CAST({k} AS DOUBLE) / {n})"
    return (f"(({p} + {z}*{z}/(2e0*{n})) {sign} {z} * SQRT(({p}*(1e0-{p}) + {z}*{z}/(4e0*{n})) / {n}))"
            f" / (1e0 + {z}*{z}/{n})")
