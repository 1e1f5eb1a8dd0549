"""Explicit schemas (DDL text) of facts, packets and stored tables."""

MATCH_PLAYER = (
    "match_id bigint, start_time int, duration smallint, game_mode tinyint, lobby_type tinyint, radiant_win boolean, "
    "patch string, is_radiant boolean, hero_id smallint, items array<smallint>, item_neutral smallint, net_worth int, "
    "gold_per_min smallint, xp_per_min smallint, kills tinyint, deaths tinyint, assists tinyint, last_hits smallint"
)

RANK = "match_id bigint, avg_rank_tier tinyint, num_rank_tier tinyint"

# Account fields are left out on purpose: a column that is not in the schema is never read.
RAW_MATCH = (
    "match_id bigint, start_time bigint, duration int, game_mode int, lobby_type int, radiant_win boolean, "
    "version int, patch int, players array<struct<hero_id:int, player_slot:int, "
    + ", ".join(f"item_{i}:int" for i in range(6))
    + ", "
    + ", ".join(f"backpack_{i}:int" for i in range(3))
    + ", item_neutral:int, net_worth:bigint, gold_per_min:int, xp_per_min:int, kills:int, deaths:int, assists:int, "
    "last_hits:int, leaver_status:int, purchase_log:array<struct<key:string, time:double>>>>"
)

PACKET = (
    "t double, data struct<auth:struct<token:string>, map:struct<matchid:string, clock_time:int, game_time:int, "
    "game_state:string, paused:boolean, daytime:boolean, win_team:string>, player:struct<team_name:string, "
    "gold:int, gold_from_income:int>, hero:struct<name:string, alive:boolean>, "
    "items:map<string, struct<name:string>>, events:array<string>>"
)

PURCHASE_SAMPLE = (
    "match_id bigint, start_time bigint, patch int, bucket string, "
    "rows array<struct<hero:int, role:string, item:string, clock:double>>"
)

# Mergeable sums: one wide row per key, one (n, w) pair per duration stratum.
COUNTS = (
    "level string, bucket string, role string, hero int, ctx string, y int, "
    + ", ".join(f"n{s} double, w{s} double" for s in range(4))
    + ", games bigint"
)

ANSWER = (
    "bucket string, role string, hero string, ctx string, place int, y int, score double, a_pp double, b_pp double, "
    "conf string, games double, rule string"
)

# Served rows of all tables with coded confidence and source; a folder per hero.
SLICE = (
    "table string, bucket string, role string, hero string, ctx string, place int, y int, score double, a_pp double, b_pp double, "
    "games bigint, conf_code int, source_code int"
)
