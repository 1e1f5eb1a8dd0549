"""The full recommendation job: games -> sums -> metrics -> shrinkage -> ranked answers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.config import Config
from skirmish.operators import answers as ans
from skirmish.operators import counts as cnt
from skirmish.operators import heroes as hero_ops
from skirmish.operators import shrink
from skirmish.operators.dims import ItemModel
from skirmish.operators.lift import metrics_of_levels
from skirmish.plans import prepare
from skirmish.session import settle_dim, stage

CLASS_LEVELS = ("L3", "L2", "hero")


@dataclass
class Recommendations:
    """Long tables; see sources.slices for the per-hero files."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    spreads: dict[str, shrink.Spread] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def drop_items(counts: DataFrame, dropped: DataFrame) -> DataFrame:
    """Remove the rows of items that are not answers; margins over "any" item stay."""
    gone = dropped.select(F.col("y"))
    return counts.join(gone, "y", "left_anti").select(*counts.columns)


ALL_TABLES = (
    "item", "item_hero", "hero", "ally", "item_class", "hero_class", "roles", "late", "matchups", "buys", "buy_share",
    "classes", "components", "team_items", "facts",
)


def finish(
    counts: DataFrame,
    comp: DataFrame,
    team_cnt: DataFrame,
    facts: DataFrame,
    model: ItemModel,
    cfg: Config,
    tables: Sequence[str] = ALL_TABLES,
) -> Recommendations:
    """Common tail of the full and the incremental job; ``counts`` are staged hero sums.

    Metrics of all levels are one job, metrics of the classes another; each level is then a
    partition of the written table.
    """
    out = Recommendations()
    dropped = settle_dim(hero_ops.unfinished(comp, cfg))
    classes = settle_dim(hero_ops.hero_classes(hero_ops.role_counts(counts), model.heroes))
    provider = cnt.GivenCounts(drop_items(counts, dropped), classes)
    floors = {"L1": cfg.conf_mid}
    base = stage(
        metrics_of_levels(provider.table(), cfg.levels, cfg.min_buy_share, floors), "metrics", ["level"]
    )

    def level(name: str, of: DataFrame = base) -> DataFrame:
        return of.where(F.col("level") == name).drop("level")

    l2, l3 = level("L2"), level("L3")
    eb = shrink.spreads(l2, cfg)
    out.spreads = eb
    ranks = {}
    if {"item", "item_hero"} & set(tables):
        s_l2 = stage(shrink.smooth(l2, eb, shrink.prior_from_mechanics(l2, l3, model.x_mech)), "s_l2")
        ranks["item"] = (s_l2, "L2", False)
        if "L1" in cfg.levels and "item_hero" in tables:
            l1 = level("L1")
            ranks["item_hero"] = (stage(shrink.smooth(l1, eb, shrink.prior_from_items(l1, s_l2)), "s_l1"), "L1", True)
    if "hero" in tables:
        ranks["hero"] = (shrink.smooth(level("hero"), eb), "hero", False)
    if {"item_class", "hero_class"} & set(tables):
        by_class = stage(metrics_of_levels(provider.table("cls"), [level for level in CLASS_LEVELS if level in cfg.levels], cfg.min_buy_share), "metrics_cls", ["level"])
        c2, c3 = level("L2", by_class), level("L3", by_class)
        if "item_class" in tables:
            s_c2 = stage(shrink.smooth(c2, eb, shrink.prior_from_mechanics(c2, c3, model.x_mech)), "s_c2")
            ranks["item_class"] = (s_c2, "L2", False)
        if "hero_class" in tables:
            ranks["hero_class"] = (shrink.smooth(level("hero", by_class), eb), "hero", False)
    for name, (smoothed, lvl, confident) in ranks.items():
        if name in tables:
            out.tables[name] = ans.rank_answers(smoothed, lvl, model.answers, eb, cfg, only_confident=confident)
    if "ally" in cfg.levels and "ally" in tables:
        team = hero_ops.team_items(team_cnt, dropped, cfg)
        out.tables["ally"] = ans.ally_answers(shrink.smooth(level("ally"), eb), team, cfg)

    out.tables["roles"] = hero_ops.role_shares(counts)
    out.tables["late"] = hero_ops.late_strength(counts)
    if "hero" in cfg.levels:
        out.tables["matchups"] = hero_ops.matchups(counts, eb["B"].k)
    shares = hero_ops.bought_shares(counts)
    out.tables["buys"] = hero_ops.buys(shares, dropped, cfg)
    out.tables["buy_share"] = hero_ops.buy_shares(shares, cfg)
    out.tables["classes"] = classes
    out.tables["components"] = comp.select("y", "share", "players", (F.col("share") >= cfg.component_final_share).alias("is_final"))
    out.tables["team_items"] = hero_ops.classify_team_items(team_cnt, dropped, cfg)
    out.tables["facts"] = facts
    return out


@dataclass
class Prepared:
    players: DataFrame  # lazily defined player games with owned sets
    teams: DataFrame  # stage table, one row per team


#: What each table is made of; the spreads always come from L2.
LEVELS_OF = {
    "item": ("L3", "L2"), "item_hero": ("L3", "L2", "L1"), "hero": ("hero",), "ally": ("ally",), "item_class": ("L3", "L2"), "hero_class": ("hero",),
    "matchups": ("hero",),
}


def needed(cfg: Config, tables: Sequence[str]) -> Config:
    """The configuration with only the levels that ``tables`` are made of; cells of a level do not depend on other levels."""
    wanted = {"L2", *(level for name in tables for level in LEVELS_OF.get(name, ()))}
    return cfg.with_(levels=tuple(level for level in cfg.levels if level in wanted))


def prepare_teams(
    matches: DataFrame,
    model: ItemModel,
    cfg: Config,
    ranks: DataFrame | None = None,
    where: Column | None = None,
    epoch: float | None = None,
    levels: tuple[str, ...] | None = None,
    unique_input: bool = False,
) -> Prepared:
    players = prepare.with_owned(prepare.player_games(matches, cfg, ranks, where, epoch, unique_input), model)
    return Prepared(players, stage(prepare.teams(players, levels or cfg.levels), "teams"))


def recommendations(
    matches: DataFrame,
    model: ItemModel,
    cfg: Config,
    ranks: DataFrame | None = None,
    where: Column | None = None,
    rank_group: str | None = None,
    tables: Sequence[str] = ALL_TABLES,
) -> Recommendations:
    """From scratch over all matches. The raw rows are read once; the team table is read three times."""
    cfg = needed(cfg, tables)
    ready = prepare_teams(matches, model, cfg, ranks, where)
    counts = stage(cnt.count_teams(ready.teams, rank_group), "counts")
    comp = settle_dim(hero_ops.component_share(ready.teams, model.parts))
    team_cnt = hero_ops.team_counts(ready.teams)
    if "ally" in tables or "team_items" in tables:
        team_cnt = settle_dim(team_cnt)
    return finish(counts, comp, team_cnt, team_facts(ready.teams), model, cfg, tables)


def group_recommendations(
    matches: DataFrame,
    model: ItemModel,
    cfg: Config,
    ranks: DataFrame | None = None,
    tables: Sequence[str] = ALL_TABLES,
) -> dict[str | None, Recommendations]:
    """``recommendations`` of all games (``None``) and, where the configuration stores them, of each rank group.

    The teams are prepared and counted once for all groups. Recipe parts, team items and facts are those of all games.
    A group without games has empty tables.
    """
    cfg = needed(cfg, tables)
    ready = prepare_teams(matches, model, cfg, ranks)
    groups = [g for g in group_names(cfg) if g is not None]
    comp = settle_dim(hero_ops.component_share(ready.teams, model.parts))
    team_cnt = hero_ops.team_counts(ready.teams)
    if "ally" in tables or "team_items" in tables:
        team_cnt = settle_dim(team_cnt)
    facts = team_facts(ready.teams)
    return {g: finish(c, comp, team_cnt, facts, model, cfg, tables) for g, c in cnt.group_counts(ready.teams, groups).items()}


def team_facts(team_rows: DataFrame) -> DataFrame:
    """Dataset facts from the team table (no second pass over the raw rows)."""
    p = team_rows.select("match_id", "start_time", "bucket", "patch", F.explode("players").alias("p"))
    return prepare.dataset_facts(
        p.select("match_id", "start_time", "bucket", "patch", F.col("p.rank_group").alias("rank_group"))
    )


def group_names(cfg: Config) -> list[str | None]:
    """Rank groups to compute: all games, and each configured group when they are stored."""
    return [None, *cfg.rank_groups] if cfg.store_rank_groups else [None]
