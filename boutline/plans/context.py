"""Schedule strength, starters, pitchers and roster composites."""

from pyspark.sql import functions as F

from boutline.operators import context as C, history as H
from boutline.plans.history import EWM
from boutline.plans.oracle import over
from boutline.plans.registry import query
from boutline.session import stored

PAST = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
SOS = dict(
    d="SELECT * FROM elog WHERE win IS NOT NULL",
    o="SELECT *, ROW_NUMBER() OVER (PARTITION BY season, entity ORDER BY game_date, game_id) AS rn FROM d",
    cum="SELECT *, SUM(win) OVER (PARTITION BY season, entity ORDER BY rn) AS w FROM o",
    # rate of each entity after its rn-th contest, valid until the next one
    iv="SELECT season, entity, game_date, game_id, CAST(w AS DOUBLE) / rn AS pct, LEAD(game_date) OVER v AS nd, LEAD(game_id) OVER v AS ng FROM cum WINDOW v AS (PARTITION BY season, entity ORDER BY rn)",
    pr="""SELECT a.season, a.entity, a.game_id, a.game_date, a.rn - b.rn AS back, b.opponent AS x FROM o a JOIN o b ON b.season = a.season AND b.entity = a.entity AND (b.rn BETWEEN a.rn - 20 AND a.rn - 1 OR b.rn BETWEEN a.rn + 1 AND a.rn + 10)""",
    rt="""SELECT pr.*, iv.pct FROM pr LEFT JOIN iv ON iv.season = pr.season AND iv.entity = pr.x AND (iv.game_date < pr.game_date OR (iv.game_date = pr.game_date AND iv.game_id < pr.game_id))
 AND (iv.nd IS NULL OR iv.nd > pr.game_date OR (iv.nd = pr.game_date AND iv.ng >= pr.game_id))""",
    s="""SELECT season, entity, game_id, AVG(CASE WHEN back > 0 THEN pct END) AS sos_past, SUM(CASE WHEN back > 0 THEN pct END) AS sos_sum, AVG(CASE WHEN back BETWEEN 1 AND 3 THEN pct END) AS sos_last3,
 AVG(CASE WHEN back < 0 THEN pct END) AS sos_ahead FROM rt GROUP BY 1, 2, 3""",
    la="SELECT o.season, o.entity, o.game_id, o.rn, CAST(c.w AS DOUBLE) / c.rn AS a FROM o JOIN cum c ON c.season = o.season AND c.entity = o.opponent AND c.game_id = o.game_id")


@query("schedule_strength", "game_id:b entity:b sos_past:d sos_sum:d sos_last3:d sos_ahead:d last_opponent_pct:d", over("elog", """
 SELECT o.game_id, o.entity, sos_past, sos_sum, sos_last3, sos_ahead, p.a AS last_opponent_pct FROM o LEFT JOIN s ON s.season = o.season AND s.entity = o.entity AND s.game_id = o.game_id
 LEFT JOIN la p ON p.season = o.season AND p.entity = o.entity AND p.rn = o.rn - 1""", **SOS))
def schedule_strength(t):
    return C.schedule_strength(t.log())


@query("schedule_percentiles", "game_id:b entity:b sos_rank:d own_rank:d", over("elog", """
 SELECT r.game_id, r.entity, CASE WHEN r.sos_past IS NOT NULL THEN 100e0 * COUNT(CASE WHEN v.pct <= ROUND(r.sos_past, 9) THEN 1 END) / NULLIF(COUNT(v.pct), 0) END AS sos_rank,
  CASE WHEN r.own IS NOT NULL THEN 100e0 * COUNT(CASE WHEN v.pct <= ROUND(r.own, 9) THEN 1 END) / NULLIF(COUNT(v.pct), 0) END AS own_rank
 FROM (SELECT o.season, o.entity, o.game_id, o.game_date, s.sos_past, c.pct AS own FROM o LEFT JOIN s ON s.season = o.season AND s.entity = o.entity AND s.game_id = o.game_id
   LEFT JOIN hold c ON c.season = o.season AND c.entity = o.entity AND c.since < o.game_date AND (c.until IS NULL OR c.until >= o.game_date)) r
 LEFT JOIN hold v ON v.season = r.season AND v.since < r.game_date AND (v.until IS NULL OR v.until >= r.game_date) GROUP BY r.game_id, r.entity, r.sos_past, r.own""", **SOS,
    hold="""SELECT season, entity, game_date AS since, LEAD(game_date) OVER w AS until, ROUND(CAST(SUM(w) OVER w AS DOUBLE) / SUM(g) OVER w, 9) AS pct FROM
 (SELECT season, entity, game_date, SUM(win) AS w, COUNT(*) AS g FROM d GROUP BY 1, 2, 3) x WINDOW w AS (PARTITION BY season, entity ORDER BY game_date)"""))
def schedule_percentiles(t):
    # Read four times: contests are worked out once.
    log = stored(t.log().select("season", "entity", "opponent", "game_id", "game_date", "win"), "log")
    rows = C.schedule_strength(log).select("season", "entity", "game_id", "game_date", "sos_past")
    own = H.with_running(log.filter("win is not null"), ["season", "entity"], H.DAY, H.TIE, strict_day=True,
                         running={"w": H.run_sum("win"), "g": H.run_count("win")})
    own = stored(own.select("season", "entity", "game_id", F.try_divide("w", "g").alias("own")), "own")
    return C.day_percentiles(log, rows.join(own, ["season", "entity", "game_id"]), {"sos_rank": "sos_past", "own_rank": "own"})


PITCH = """SELECT member, game_id, entity, game_date, CASE WHEN points >= 25 THEN 1 ELSE 0 END AS started, CAST(minutes AS BIGINT) % 28 AS outs, CAST(shots AS BIGINT) AS er, CAST(points AS BIGINT) % 9 AS hits,
 CAST(minutes AS BIGINT) % 4 AS walks, CAST(points AS BIGINT) % 11 AS k, CAST(shots AS BIGINT) % 3 AS hr FROM {m}"""
PCOLS = ["era_pre", "whip_pre", "k9_pre", "bb9_pre", "hr9_pre", "recent3_ip_pre", "recent3_era_pre", "recent3_whip_pre", "recent3_k9_pre"]


@query("pitcher_prior", "game_id:b entity:b member:b no_prior:b starts_pre:b ip_pre:d " + " ".join(f"{c}:d" for c in PCOLS), over("members", f"""
 SELECT c.game_id, c.entity, c.member, CASE WHEN COALESCE(co, 0) > 0 THEN 0 ELSE 1 END AS no_prior, COALESCE(cs, 0) AS starts_pre, COALESCE(co, 0) / 3e0 AS ip_pre,
  CASE WHEN co > 0 THEN ce * 27e0 / co END AS era_pre, CASE WHEN co > 0 THEN (ch + cw) * 3e0 / co END AS whip_pre, CASE WHEN co > 0 THEN ck * 27e0 / co END AS k9_pre, CASE WHEN co > 0 THEN cw * 27e0 / co END AS bb9_pre,
  CASE WHEN co > 0 THEN cr * 27e0 / co END AS hr9_pre, CASE WHEN co > 0 THEN COALESCE(r.o, 0) / 3e0 ELSE 0 END AS recent3_ip_pre, CASE WHEN co > 0 AND r.o > 0 THEN r.e * 27e0 / r.o END AS recent3_era_pre,
  CASE WHEN co > 0 AND r.o > 0 THEN (r.h + r.w) * 3e0 / r.o END AS recent3_whip_pre, CASE WHEN co > 0 AND r.o > 0 THEN r.k * 27e0 / r.o END AS recent3_k9_pre
 FROM c JOIN p1 s ON s.game_id = c.game_id AND s.entity = c.entity AND s.member = c.member
 LEFT JOIN (SELECT a.member, a.game_id, a.entity, SUM(b.outs) AS o, SUM(b.er) AS e, SUM(b.hits) AS h, SUM(b.walks) AS w, SUM(b.k) AS k FROM c a JOIN st b ON b.member = a.member AND b.sn BETWEEN a.cs - 2 AND a.cs GROUP BY 1, 2, 3) r
  ON r.member = c.member AND r.game_id = c.game_id AND r.entity = c.entity""",
    pl=PITCH.format(m="members"), p1="SELECT game_id, entity, member FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY game_id, entity ORDER BY points DESC, member) AS r FROM members) x WHERE r = 1",
    c=f"""SELECT *, SUM(started) OVER v AS cs, SUM(outs) OVER v AS co, SUM(er) OVER v AS ce, SUM(hits) OVER v AS ch, SUM(walks) OVER v AS cw, SUM(k) OVER v AS ck, SUM(hr) OVER v AS cr
 FROM pl WINDOW v AS (PARTITION BY member ORDER BY game_date, game_id, entity {PAST})""",
    st="SELECT *, ROW_NUMBER() OVER (PARTITION BY member ORDER BY game_date, game_id, entity) AS sn FROM pl WHERE started = 1"))
def pitcher_prior(t):
    m = t.members()
    m.createOrReplaceTempView("boutline_members")
    logs = t.spark.sql(PITCH.format(m="boutline_members"))
    return C.pitcher_prior(logs, H.primary_member(m, history=False), t.parts("lineitem"))


KEEPERS = """SELECT game_id, entity, member, CASE WHEN CAST(points AS BIGINT) % 5 = 0 THEN 1 ELSE 0 END AS api_flag, CASE WHEN points > 12 THEN 1 ELSE 0 END AS played,
 CAST(CASE WHEN minutes > 40 THEN minutes ELSE 0 END AS BIGINT) AS toi, CAST(shots AS BIGINT) % 6 AS shots, CAST(minutes AS BIGINT) % 6 AS rest_days, CAST(points AS BIGINT) AS pts FROM {m}"""


@query("infer_starter", "game_id:b entity:b member:b source:s confidence:d", over("members", """
 SELECT game_id, entity, member, CASE WHEN flags = 1 THEN 'api_flag' WHEN flags > 1 THEN 'api_flag_conflict_resolved' WHEN tier = 2 THEN 'inferred_played_toi' WHEN tier = 3 THEN 'inferred_played_shots_against' WHEN tier = 4 THEN 'inferred_played_fallback' ELSE 'inferred_roster_fallback' END AS source,
  CASE WHEN flags = 1 THEN 1e0 WHEN flags > 1 THEN 0.75e0 WHEN tier = 2 THEN 0.9e0 WHEN tier = 3 THEN 0.8e0 WHEN tier = 4 THEN 0.65e0 ELSE 0.5e0 END AS confidence
 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY game_id, entity ORDER BY tier, CASE WHEN tier = 5 THEN 0 ELSE played END DESC, CASE WHEN tier = 5 THEN 0 ELSE toi END DESC, CASE WHEN tier = 5 THEN 0 ELSE shots END DESC, member) AS r FROM
  (SELECT *, SUM(api_flag) OVER (PARTITION BY game_id, entity) AS flags, CASE WHEN api_flag = 1 THEN 1 WHEN played = 1 AND toi > 0 THEN 2 WHEN played = 1 AND shots > 0 THEN 3 WHEN played = 1 THEN 4 ELSE 5 END AS tier FROM kp) x) y WHERE r = 1""",
    kp=KEEPERS.format(m="members")))
def infer_starter(t):
    t.members().createOrReplaceTempView("boutline_members")
    return C.infer_starter(t.spark.sql(KEEPERS.format(m="boutline_members")), ["game_id", "entity"])


@query("starter_certainty", "game_id:b entity:b member:b score:d certainty:d quality_gap:d", over("members", """
 SELECT game_id, entity, member, score, EXP(score) / z AS certainty, q - COALESCE((qs - q) / NULLIF(n - 1, 0), 0.905e0) AS quality_gap
 FROM (SELECT *, SUM(EXP(score)) OVER g AS z, COUNT(*) OVER g AS n, SUM(q) OVER g AS qs, ROW_NUMBER() OVER (PARTITION BY game_id, entity ORDER BY score DESC, member) AS r FROM
  (SELECT *, 0.85e0 + pts / 500e0 AS q, GREATEST(0e0, LEAST(1e0, 0.48e0 * played + 0.2e0 * api_flag + 0.12e0 * (shots % 2) + 0.12e0 * (shots / 10e0) + 0.06e0 * (shots / 5e0) + 0.1e0 * GREATEST(0e0, LEAST(1e0, rest_days / 4e0))
    + CASE WHEN entity % 2 = 1 THEN CASE WHEN rest_days <= 1 THEN -0.18e0 WHEN rest_days >= 2 THEN 0.1e0 ELSE -0.05e0 END ELSE 0e0 END)) AS score FROM kp) x WINDOW g AS (PARTITION BY game_id, entity)) y WHERE r = 1""",
    kp=KEEPERS.format(m="members")))
def starter_certainty(t):
    t.members().createOrReplaceTempView("boutline_members")
    k = t.spark.sql(KEEPERS.format(m="boutline_members")).withColumns({
        "role": F.col("played"), "api": F.col("api_flag"), "source": F.col("shots") % 2, "rate10": F.col("shots") / 10.0, "rate5": F.col("shots") / 5.0,
        "back_to_back": F.col("entity") % 2, "quality": 0.85 + F.col("pts") / 500.0})
    return C.starter_certainty(k, ["game_id", "entity"])


@query("form_adjusted", "game_id:b entity:b form_score:d adjusted:d form_adj_last5:d form_adj_last10:d form_var_last5:d form_ewm:d roster_index:d", over("elog members", f"""
 SELECT *, COALESCE(form_adj_last5 * 1.8e0, 0) + COALESCE(form_var_last5 * -0.9e0, 0) + COALESCE((form_score - 20e0) * 0.1e0, 0) AS roster_index FROM (SELECT game_id, entity, form_score, adjusted, AVG(adjusted) OVER w5 AS form_adj_last5, AVG(adjusted) OVER w10 AS form_adj_last10, VAR_POP(form_score) OVER w5 AS form_var_last5, {EWM.format(0.45).replace('l)', 'ls)').replace('(l,', '(ls,')} AS form_ewm
 FROM (SELECT *, LIST(form_score) OVER (PARTITION BY entity ORDER BY game_date, game_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS ls FROM x) y
 WINDOW w5 AS (PARTITION BY entity ORDER BY game_date, game_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), w10 AS (PARTITION BY entity ORDER BY game_date, game_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) z""",
    r=f"SELECT *, CAST(SUM(win) OVER w AS DOUBLE) / NULLIF(COUNT(win) OVER w, 0) AS pct FROM elog WHERE win IS NOT NULL WINDOW w AS (PARTITION BY entity, season ORDER BY game_date, game_id {PAST})",
    f="SELECT game_id, entity, 1.8e0 * AVG(points) AS form_score FROM members GROUP BY 1, 2",
    x="SELECT r.game_id, r.entity, r.game_date, f.form_score, f.form_score - o.pct AS adjusted FROM r JOIN f ON f.game_id = r.game_id AND f.entity = r.entity JOIN r o ON o.game_id = r.game_id AND o.entity = r.opponent"))
def form_adjusted(t):
    out = C.form_adjusted(t.members(), t.log())
    return C.weighted_index(out, {"form_adj_last5": (1.8, 0.0), "form_var_last5": (-0.9, 0.0), "form_score": (0.1, 20.0)}, "roster_index")


@query("core_retention", "game_id:b entity:b active:b core:b retained:b key_present:b absent:b retention:d")
def core_retention(t):
    return C.core_retention(t.members())
