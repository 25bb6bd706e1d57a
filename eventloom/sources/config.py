"""Editorial policy, rubrics and register seeds as strict, typed input.

Parsing is strict: unknown or missing keys, empty channels, shares out of range and undated
positions raise ConfigError. Term lists become small DataFrames for joins.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from eventloom.schemas import EVENT_TYPES


class ConfigError(ValueError):
    """A configuration that must not be used."""


def load_yaml(text: str) -> dict:
    """YAML text as a mapping; needs PyYAML."""
    try:
        import yaml
    except ImportError as e:
        raise ConfigError("reading YAML needs PyYAML") from e
    try:
        out = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ConfigError(f"not YAML: {e}") from e
    if not isinstance(out, Mapping):
        raise ConfigError("the top level must be a mapping")
    return dict(out)


@dataclass(frozen=True)
class Position:
    ticker: str
    name: str
    thesis: str
    exposure_terms: tuple[str, ...]
    weight_pct: float | None = None


@dataclass(frozen=True)
class Policy:
    version: int
    owner: str | None
    channels: Mapping[str, tuple[str, ...]]
    event_type_prior: Mapping[str, int]
    slate_k: int
    hand_weights: Mapping[str, float]
    positions: tuple[Position, ...] = ()
    positions_as_of: date | None = None
    positions_source: str | None = None
    window_days: int = 90
    show_undated: bool = False
    max_per_lab: int = 0
    story_rare_df: float = 0.0
    story_days: int = 7
    mobility_window_days: int = 90
    extra: Mapping[str, object] = field(default_factory=dict)

    @property
    def is_owned(self) -> bool:
        """False without an owner and for a placeholder."""
        return bool(self.owner) and UNASSIGNED not in self.owner.lower()

    def terms(self, spark: SparkSession) -> DataFrame:
        """(channel, ord, term) in the order given."""
        rows = [(c, i, t) for i, (c, ts) in enumerate(self.channels.items()) for t in ts]
        return spark.createDataFrame(rows, "channel string, ord int, term string")

    def exposure_terms(self, spark: SparkSession) -> DataFrame:
        """(ticker, term) of the positions' vocabularies."""
        return spark.createDataFrame([(p.ticker, t) for p in self.positions for t in p.exposure_terms], "ticker string, term string")


# The names in policy files.
UNASSIGNED = "unassigned"
_HOLDING = {"ticker", "name", "thesis", "exposure_terms"}
_NEEDED = {"version", "owner", "channels", "event_type_prior", "slate_k", "hand_weights"}
_KNOWN = _NEEDED | {"effective_from", "source", "positions", "window_days", "show_undated", "max_per_lab", "story_rare_df", "story_days", "mobility_window_days", "primary_rubric", "require_mechanism", "require_holding_link"}


def _keys(raw: Mapping, needed: set[str], known: set[str], where: str) -> None:
    if missing := needed - set(raw):
        raise ConfigError(f"{where}: missing {sorted(missing)}")
    if odd := set(raw) - known:
        raise ConfigError(f"{where}: unknown {sorted(odd)}")


def _whole(raw: Mapping, key: str, default: int) -> int:
    value = raw.get(key, default)
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise ConfigError(f"{key} must be a whole number of 0 or more, not {value!r}")
    return value


def parse_policy(raw: Mapping) -> Policy:
    _keys(raw, _NEEDED, _KNOWN, "policy")
    channels = {}
    for name, terms in dict(raw["channels"] or {}).items():
        if not terms or not all(isinstance(t, str) and t.strip() for t in terms):
            raise ConfigError(f"channel {name!r} has no usable terms")
        channels[name] = tuple(t.lower() for t in terms)
    if not channels:
        raise ConfigError("no channel is defined")
    prior = dict(raw["event_type_prior"] or {})
    if odd := set(prior) - set(EVENT_TYPES):
        raise ConfigError(f"event_type_prior: unknown types {sorted(odd)}")
    share = raw.get("story_rare_df", 0.0)
    if isinstance(share, bool) or not isinstance(share, (int, float)) or not 0 <= share <= 1:
        raise ConfigError(f"story_rare_df must lie between 0 and 1, not {share!r}")
    held = raw.get("positions") or {}
    if not isinstance(held, Mapping):
        raise ConfigError("positions must be a mapping of as_of, source and holdings")
    _keys(held, set(), {"as_of", "source", "holdings"}, "positions")
    positions = []
    for p in held.get("holdings") or ():
        _keys(p, _HOLDING, _HOLDING | {"weight_pct"}, "holding")
        if not all(p[k] for k in _HOLDING):
            raise ConfigError(f"holding {p['ticker']!r}: {sorted(_HOLDING)} must not be empty")
        weight = None if p.get("weight_pct") is None else float(p["weight_pct"])
        positions.append(Position(str(p["ticker"]).upper(), str(p["name"]), str(p["thesis"]), tuple(str(t).lower() for t in p["exposure_terms"]), weight))
    if positions and not held.get("as_of"):
        raise ConfigError("positions must say of which day they are")
    return Policy(
        version=_whole(raw, "version", 0),
        owner=raw["owner"],
        channels=channels,
        event_type_prior=prior,
        slate_k=_whole(raw, "slate_k", 15),
        hand_weights={k: float(v) for k, v in dict(raw["hand_weights"] or {}).items()},
        positions=tuple(positions),
        positions_as_of=_day(held["as_of"]) if held.get("as_of") else None,
        positions_source=held.get("source"),
        window_days=_whole(raw, "window_days", 90),
        show_undated=bool(raw.get("show_undated", False)),
        max_per_lab=_whole(raw, "max_per_lab", 0),
        story_rare_df=float(share),
        story_days=_whole(raw, "story_days", 7),
        mobility_window_days=_whole(raw, "mobility_window_days", 90),
        extra={k: raw[k] for k in ("effective_from", "source", "primary_rubric", "require_mechanism", "require_holding_link") if k in raw},
    )


def _day(value: object) -> date:
    try:
        return value if isinstance(value, date) else date.fromisoformat(str(value))
    except ValueError as e:
        raise ConfigError(f"positions must be dated, not {value!r}") from e


@dataclass(frozen=True)
class Rubric:
    name: str
    version: int
    audience: str
    question: str
    rules: tuple[str, ...]
    banned: tuple[str, ...] = ()

    def labeler(self, kind: str, who: str) -> str:
        return f"{kind}:{who}/{self.name}/r{self.version}"


def parse_rubric(raw: Mapping) -> Rubric:
    needed = {"name", "version", "audience", "question", "rules"}
    _keys(raw, needed, needed | {"banned", "owner", "notes"}, "rubric")
    if not raw["rules"]:
        raise ConfigError("a rubric needs rules")
    return Rubric(raw["name"], _whole(raw, "version", 1), raw["audience"], raw["question"], tuple(raw["rules"]), tuple(raw.get("banned") or ()))
