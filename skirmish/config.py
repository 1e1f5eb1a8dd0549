"""Parameters of the method. Nothing below is hard-coded in operators."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

DAY = 86_400

# Default parameters of the published method.
DURATION_EDGES_MIN = {"normal": (25, 35, 45), "turbo": (15, 22, 30)}
RANK_GROUPS = {"G1": (10, 39), "G2": (40, 59), "G3": (60, 89)}
LEVELS = ("L3", "L2", "hero", "ally")
SWEEP_PP = (0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 5.0)
EPS = 1e-6


@dataclass(frozen=True)
class Config:
    duration_edges: dict = field(default_factory=lambda: dict(DURATION_EDGES_MIN))
    candidate_min_cost: int = 1000
    key_item_min_cost: int = 2000
    extra_candidates: tuple = ("blink",)
    exclude_tree_of: str | None = "boots"
    keep_from_excluded: tuple = ("guardian_greaves",)
    rank_groups: dict = field(default_factory=lambda: dict(RANK_GROUPS))
    store_rank_groups: bool = False
    half_life_days: float = 21.0
    k_a_default: float = 200.0
    k_b_default: float = 800.0
    eb_min_games: float = 1000.0
    lam: float = 0.0
    veto_b: float = 2.0
    z90: float = 1.645
    conf_high: float = 1000.0
    conf_mid: float = 300.0
    top_n: int = 6
    adaptation_top: int = 5
    min_buy_share: float = 0.03
    component_final_share: float = 0.5
    min_role_share: float = 0.1
    broad_rule_share: float = 0.4
    mechanic_first: bool = True
    mechanic_first_min_a: float | None = 0.0
    mechanic_first_b_significant: bool = False
    levels: tuple = LEVELS
    counter_min_a_pp: float | None = 3.0
    team_item_max_ratio: float = 0.85
    team_item_min_pairs: float = 100.0
    buy_share_floor: float = 0.01

    @property
    def half_life_sec(self) -> float:
        return self.half_life_days * DAY

    def with_(self, **changes) -> "Config":
        return replace(self, **changes)


def load_config(path: str | Path) -> Config:
    """Read the JSON parameter file; keys that only explain or tune another engine are ignored."""
    raw = json.loads(Path(path).read_text(encoding="utf-8"))
    known = {f.name for f in fields(Config)}
    values = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in known}
    return Config(**values)


@dataclass(frozen=True)
class AdviceConfig:
    phase_base_cost: float = 2500.0
    phase_cost_per_min: float = 200.0
    multi_threat_bonus: float = 0.5
    hysteresis: float = 0.5
    top_for_bonus: int = 3
    show_delta_min_pp: float = 1.0
    ally_filter: bool = True


@dataclass(frozen=True)
class ThreatConfig:
    w_farm: float = 3.0
    w_late: float = 0.5
    w_matchup: float = 0.5
    w_winrate: float = 0.5
    min_length_games: float = 200.0
    min_pair_games: float = 150.0
    carry_rank: float = 1.8
    core_rank: float = 2.8
    late_notable: float = 3.0
    matchup_notable: float = 3.0


@dataclass(frozen=True)
class UpliftConfig:
    min_pair_games: int = 150
    min_base_games: int = 20
    min_buy_share: float = 0.03
    z: float = 1.64
    wr_filter_games: int = 500
    multi_threat_bonus: float = 1.0
    hysteresis: float = 1.5
    phase_base_cost: float = 2500.0
    phase_cost_per_min: float = 200.0
    per_threat: int = 2


@dataclass(frozen=True)
class HintConfig:
    min_own_share: float = 2.0
    fallback_share: float = 3.0
    limit: int = 2


@dataclass(frozen=True)
class TimingConfig:
    max_matches: int = 3000
    seen_limit: int = 6000
    min_samples: int = 10
    max_age_days: int = 14
    allowed_lobbies: tuple = (0, 7)


@dataclass(frozen=True)
class AlertConfig:
    merge_window_sec: int = 5
    voice_interval_sec: float = 8.0
    silence_sec: float = 60.0
    max_late_sec: int = 3
    trigger_dedup_sec: int = 60
