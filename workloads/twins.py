"""SQL of the statistics, from their definitions.

One table of sums over (context, item) serves each level: a game adds to its context and item, to "any context" (``*``)
and to "any item" (``-1``). The four cells of a pair, context seen or not by item bought or not, are signed totals of the
four sums; lifts and differences come from the cells in long form, a row a cell.
"""

from __future__ import annotations

ANY_CTX, ANY_ITEM = "'*'", "-1"
Z90 = "1.645"

#: What a side of a match shows; each kind is (match_id, is_radiant, mark).
SHOWN = {
    "hero": "SELECT match_id, is_radiant, hero::VARCHAR AS mark FROM {games}",
    "L1": "SELECT match_id, is_radiant, concat_ws(':', hero, x) AS mark FROM owned_x",
    "L2": "SELECT match_id, is_radiant, x::VARCHAR AS mark FROM owned_x",
    "L3": "SELECT match_id, is_radiant, mech AS mark FROM owned_x NATURAL JOIN x_mech",
}
SHOWN["ally"] = SHOWN["hero"]


def faced(level: str, games: str = "pg") -> str:
    """(match_id, is_radiant, ctx): what the players of a side see, on the other side or (ally) on their own."""
    side = "is_radiant" if level == "ally" else "NOT is_radiant"
    sides = "" if level == "ally" else f" SEMI JOIN (SELECT match_id, is_radiant FROM {games}) USING (match_id, is_radiant)"
    return f"SELECT * FROM (SELECT DISTINCT match_id, {side} AS is_radiant, mark AS ctx FROM ({SHOWN[level].format(games=games)})){sides}"


NO_ITEMS_LEFT_OUT = "dropped AS (SELECT 0 AS y WHERE false)"
#: Parts of recipes that few of their owners end a game with.
PARTS_LEFT_OUT = """
component_share AS (
  SELECT y, count(*) AS players, count_if(list_contains(items, y))::BIGINT AS itself, itself / players AS share
  FROM owned_y SEMI JOIN parts USING (y) JOIN pg USING (match_id, is_radiant, hero) GROUP BY y
),
dropped AS (SELECT y FROM component_share WHERE share < 0.4)"""
#: The role that a hero plays most; on a tie the one named first.
CLASSES = """
main_roles AS (
  SELECT hero, role AS main_role FROM pg GROUP BY hero, role
  QUALIFY row_number() OVER (PARTITION BY hero ORDER BY count(*) DESC, list_position(['core', 'offlane', 'support'], role)) = 1
),
classes AS (SELECT hero, coalesce(attr, 'all') || '-' || main_role AS cls, main_role FROM main_roles LEFT JOIN heroes USING (hero))"""


def sums(level: str | None, tag: str = "", who: str = "hero", games: str = "pg") -> str:
    """CTE ``sums<tag>`` (bucket, role, hero, ctx, y, stratum, n, w)."""
    seen = f"SELECT match_id, is_radiant, list(ctx) AS ctxs FROM ({faced(level, games)}) GROUP BY ALL" if level else "SELECT 0 AS match_id, false AS is_radiant, [''] AS ctxs WHERE false"
    as_class = "JOIN classes USING (hero)" if who == "cls" else ""
    return f"""
bought{tag} AS (SELECT match_id, is_radiant, hero, list(y) AS ys FROM owned_y ANTI JOIN dropped USING (y) GROUP BY ALL),
faced{tag} AS ({seen}),
sums{tag} AS (
  SELECT bucket, role, hero, ctx, y, stratum, sum(wt) AS n, coalesce(sum(wt) FILTER (win), 0) AS w
  FROM (SELECT *, unnest(list_prepend({ANY_ITEM}, coalesce(ys, []))) AS y
        FROM (SELECT bucket, role, {who} AS hero, stratum, wt, win, ys, unnest(list_prepend({ANY_CTX}, coalesce(ctxs, []))) AS ctx
              FROM {games} {as_class} LEFT JOIN bought{tag} USING (match_id, is_radiant, hero) LEFT JOIN faced{tag} USING (match_id, is_radiant)))
  GROUP BY ALL
)"""


def part_of_sums(ctx: bool, item: bool, tag: str = "") -> str:
    """The sums with a context or without, with an item or without, rounded for comparison."""
    names = ["bucket", "role", "hero", *(["ctx"] if ctx else []), *(["y"] if item else []), "stratum"]
    return (
        f"SELECT {', '.join(names)}, round(n, 5) AS n, round(w, 5) AS w FROM sums{tag} "
        f"WHERE ctx {'<>' if ctx else '='} {ANY_CTX} AND y {'<>' if item else '='} {ANY_ITEM}"
    )


KEYS = "bucket, role, hero, ctx, y"


def effects(dst: str, tag: str = "", min_buy_share: float = 0.03, min_ctx: float = 0.0) -> str:
    """CTEs up to ``dst`` (bucket, role, hero, ctx, y, lift_a, var_a, diff_b, var_b, games)."""
    return f"""
margin{tag} AS (SELECT {KEYS}, sum(n) AS n FROM sums{tag} WHERE ctx = {ANY_CTX} OR y = {ANY_ITEM} GROUP BY ALL),
asked{tag} AS (
  SELECT DISTINCT pair.bucket, pair.role, pair.hero, pair.ctx, pair.y, faced.n AS games
  FROM (SELECT * FROM sums{tag} WHERE ctx <> {ANY_CTX} AND y <> {ANY_ITEM}) pair
  JOIN margin{tag} every ON (every.bucket, every.role, every.hero, every.ctx, every.y) = (pair.bucket, pair.role, pair.hero, {ANY_CTX}, {ANY_ITEM})
  JOIN margin{tag} bought ON (bought.bucket, bought.role, bought.hero, bought.ctx, bought.y) = (pair.bucket, pair.role, pair.hero, {ANY_CTX}, pair.y)
  JOIN margin{tag} faced ON (faced.bucket, faced.role, faced.hero, faced.ctx, faced.y) = (pair.bucket, pair.role, pair.hero, pair.ctx, {ANY_ITEM})
  WHERE bought.n >= {min_buy_share} * every.n AND faced.n >= {min_ctx}
),
cell{tag} AS (
  SELECT a.*, s.stratum, sees, buys, sum(s.n * sign) AS n, sum(s.w * sign) AS w
  FROM asked{tag} a
  CROSS JOIN (VALUES (false, false, 0, 0, 1), (true, false, 1, 0, 1), (true, false, 0, 0, -1), (false, true, 0, 1, 1), (false, true, 0, 0, -1),
                     (true, true, 1, 1, 1), (true, true, 1, 0, -1), (true, true, 0, 1, -1), (true, true, 0, 0, 1)) part(of_ctx, of_item, sees, buys, sign)
  JOIN sums{tag} s ON s.bucket = a.bucket AND s.role = a.role AND s.hero = a.hero
   AND s.ctx = if(of_ctx, a.ctx, {ANY_CTX}) AND s.y = if(of_item, a.y, {ANY_ITEM})
  GROUP BY ALL HAVING sum(s.n * sign) > 1e-6
),
bought_when{tag} AS (
  SELECT {KEYS}, stratum, sees, sum(n) AS size, coalesce(sum(n) FILTER (buys = 1), 0) / sum(n) AS p FROM cell{tag} GROUP BY ALL
),
lifts{tag} AS (
  SELECT {KEYS}, sum(size * a) / sum(size) AS lift_a, sum(size * size * v) / sum(size) ** 2 AS var_a FROM (
    SELECT {KEYS}, stratum, sum(if(sees = 1, p, -p)) AS a, sum(p * (1 - p) / size) AS v, max(size) FILTER (sees = 1) AS size
    FROM bought_when{tag} GROUP BY ALL HAVING count(*) = 2) GROUP BY ALL
),
differences{tag} AS (
  SELECT {KEYS}, sum(size * b) / sum(size) AS diff_b, sum(size * size * v) / sum(size) ** 2 AS var_b FROM (
    SELECT {KEYS}, stratum, sum(if(sees = buys, rate, -rate)) AS b, sum(rate * (1 - rate) / n) AS v, sum(n) FILTER (sees = 1) AS size
    FROM (SELECT *, least(greatest(w, 0) / n, 1) AS rate FROM cell{tag}) GROUP BY ALL HAVING count(*) = 4) GROUP BY ALL
),
{dst} AS (
  SELECT {KEYS}, lift_a, var_a, diff_b, var_b, games
  FROM asked{tag} LEFT JOIN lifts{tag} USING ({KEYS}) LEFT JOIN differences{tag} USING ({KEYS})
)"""


def level(name: str, dst: str, who: str = "hero", min_ctx: float = 0.0, games: str = "pg") -> str:
    """All CTEs of one level; ``dst`` also marks their names, so that several levels fit one statement."""
    return sums(name, f"_{dst}", who, games) + "," + effects(dst, f"_{dst}", 0.03, min_ctx)


def spread(src: str) -> str:
    """CTE ``spread`` (metric, tau2, k): how far true values differ between cells, by moments; too few cells take a default."""
    return f"""
spread AS (
  SELECT metric, if(told, between_cells, coalesce(nullif(any_noise, 0), 0.25) / usual) AS tau2, if(told, noise / between_cells, usual) AS k
  FROM (
    SELECT metric, usual, avg(v * games) FILTER (v > 0 AND games > 0) AS any_noise, avg(v * games) FILTER (good) AS noise,
           var_samp(value) FILTER (good) - avg(v) FILTER (good) AS between_cells,
           coalesce(count_if(good) >= 30 AND between_cells > 0 AND noise <> 0, false) AS told
    FROM (
      SELECT *, value IS NOT NULL AND v > 0 AND games >= 20 AS good FROM (
        SELECT 'A' AS metric, lift_a AS value, var_a AS v, games, 200.0::DOUBLE AS usual FROM {src}
        UNION ALL SELECT 'B', diff_b, var_b, games, 800.0 FROM {src}))
    GROUP BY metric, usual)
)"""


def shrunk(src: str, dst: str, prior: str | None = None, prior_ctx: str = "s.ctx") -> str:
    """CTE ``dst``: each value moved towards its prior (bucket, role, hero, ctx, y, a, b; else zero) by its share of noise."""
    towards = f"LEFT JOIN {prior} p ON (p.bucket, p.role, p.hero, p.ctx, p.y) = (s.bucket, s.role, s.hero, {prior_ctx}, s.y)" if prior else ""
    a, b = ("coalesce(p.a, 0)", "coalesce(p.b, 0)") if prior else ("0", "0")
    return f"""
{dst} AS (
  SELECT *, coalesce(to_a + trust_a * (lift_a - to_a), to_a) AS a_s, trust_a * var_a AS va_s,
         coalesce(to_b + trust_b * (diff_b - to_b), to_b) AS b_s, trust_b * var_b AS vb_s
  FROM (
    SELECT s.*, {a} AS to_a, {b} AS to_b, ta.tau2 AS tau_a,
           if(coalesce(var_a, 0) > 0, ta.tau2 / (ta.tau2 + var_a), 1) AS trust_a, if(coalesce(var_b, 0) > 0, tb.tau2 / (tb.tau2 + var_b), 1) AS trust_b
    FROM {src} s JOIN spread ta ON ta.metric = 'A' JOIN spread tb ON tb.metric = 'B' {towards})
)"""


#: Prior of an enemy item: the mean over the mechanics that it has.
MECHANICS_PRIOR = """
mechanics_prior AS (
  SELECT bucket, role, hero, x::VARCHAR AS ctx, y, avg(lift_a) AS a, avg(diff_b) AS b FROM met_l3 JOIN x_mech ON mech = ctx GROUP BY ALL
)"""
#: Prior of a hero with an item: the item alone.
ITEMS_PRIOR = "items_prior AS (SELECT bucket, role, hero, ctx, y, a_s AS a, b_s AS b FROM s_l2)"


def ranked(src: str, rules: list[tuple[str, str]], sure_only: bool = False, tag: str = "") -> str:
    """CTEs up to ``placed<tag>``: the answers of each (bucket, role, hero, ctx) in order. ``rules``: kinds of rules, first wins,
    with the part of ``ctx`` that they look at."""
    told = " UNION ALL ".join(
        f"SELECT s.ctx, s.y, r.rule, r.broad, {i} AS turn FROM (SELECT DISTINCT ctx, y FROM {src}) s JOIN rule_of r ON (r.kind, r.ctx, r.y) = ('{kind}', {part}, s.y)"
        for i, (kind, part) in enumerate(rules)
    )
    sure = "AND conf <> 'low'" if sure_only else ""
    return f"""
told{tag} AS (SELECT DISTINCT ON (ctx, y) * FROM ({told}) ORDER BY ctx, y, turn),
weighed{tag} AS (
  SELECT {src}.*, a_s - {Z90} * sqrt(greatest(coalesce(va_s, 0), 0)) AS a_low, b_s + {Z90} * sqrt(if(vb_s < 0, 0, vb_s)) AS b_high,
         a_s / (SELECT stddev_samp(a_s) FROM {src}) AS score, rule AS named, coalesce(broad, false) AS broad
  FROM {src} LEFT JOIN told{tag} USING (ctx, y)
),
graded{tag} AS (
  SELECT * REPLACE (if(broad AND a_low <= 0, NULL, named) AS named),
         if(coalesce(var_a > tau_a, true) OR games < 20, 'low', if(games < 60, 'mid', 'high')) AS conf,
         row_number() OVER (PARTITION BY bucket, role, hero, ctx ORDER BY round(a_s, 9) DESC, y) AS by_lift
  FROM weighed{tag} WHERE a_s IS NOT NULL
),
placed{tag} AS (
  SELECT * RENAME (named AS rule), row_number() OVER (PARTITION BY bucket, role, hero, ctx ORDER BY named IS NULL OR a_s <= 0, round(score, 9) DESC, y) AS place
  FROM graded{tag}
  WHERE (by_lift <= 5 OR named IS NOT NULL) AND coalesce(b_high * 100 >= -2, true) AND a_low > 0 AND a_s * 100 >= 1 {sure}
)"""


#: Pairs of owners of an item in one team, seen and as many as there would be if each player bought alone: the second
#: is a sum over pairs of (hero, role), as often as they play together, of the product of their odds.
TEAM = """
plays AS (SELECT match_id, is_radiant, bucket, hero, role FROM pg),
odds AS (
  SELECT bucket, hero, role, y, count(*) / any_value(times) AS p
  FROM owned_y NATURAL JOIN plays NATURAL JOIN (SELECT bucket, hero, role, count(*) AS times FROM plays GROUP BY ALL) GROUP BY ALL
),
mates AS (
  SELECT a.bucket, a.hero AS hero_a, a.role AS role_a, b.hero AS hero_b, b.role AS role_b, count(*) AS times
  FROM plays a JOIN plays b ON a.match_id = b.match_id AND a.is_radiant = b.is_radiant AND a.hero < b.hero GROUP BY ALL
),
chance AS (
  SELECT m.bucket, a.y, sum(times * a.p * b.p) AS expected
  FROM mates m JOIN odds a ON (a.bucket, a.hero, a.role) = (m.bucket, hero_a, role_a) JOIN odds b ON (b.bucket, b.hero, b.role, b.y) = (m.bucket, hero_b, role_b, a.y)
  GROUP BY ALL
),
both_own AS (
  SELECT bucket, a.y, count(*) AS pairs FROM owned_y a JOIN owned_y b ON a.match_id = b.match_id AND a.is_radiant = b.is_radiant AND a.y = b.y AND a.hero < b.hero
  JOIN plays p ON (p.match_id, p.is_radiant, p.hero) = (a.match_id, a.is_radiant, a.hero) GROUP BY ALL
),
team_pairs AS (
  SELECT bucket, y, coalesce(pairs, 0)::DOUBLE AS pairs, coalesce(expected, 0)::DOUBLE AS expected
  FROM (SELECT DISTINCT bucket, y FROM odds) LEFT JOIN chance USING (bucket, y) LEFT JOIN both_own USING (bucket, y)
),
team_items AS (SELECT bucket, y FROM team_pairs ANTI JOIN dropped USING (y) WHERE expected >= 2 AND pairs <= 0.98 * expected)"""


ANSWER_COLS = """bucket, role, CAST(hero AS VARCHAR) AS hero, ctx, CAST(place AS INTEGER) AS place, y, round(score, 5) AS score, round(a_s, 6) AS a_s, round(b_s, 6) AS b_s,
conf, round(games, 5) AS games, rule"""
S_L2 = (PARTS_LEFT_OUT, level("L2", "met_l2"), level("L3", "met_l3"), spread("met_l2"), MECHANICS_PRIOR, shrunk("met_l2", "s_l2", "mechanics_prior"))
