"""Ratings from stints: all metrics by season with a chosen penalty, rolling windows of games, and checks of both.

Values can't be written in SQL, so each fit has a query that puts its coefficients back into the normal equations, row by
row and not by the moments they came from; SQL gives the names that must be there and 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isochron.operators import aggregates as A
from isochron.operators import regression as R
from isochron.operators import ridge as G
from isochron.operators.gates import only_passed
from isochron.plans import stints as P
from isochron.plans.feed import Feed
from isochron.plans.queries_gates import GATE, judged
from isochron.plans.registry import query
from isochron.plans.sql import EVEN, LINEUPS, UNEVEN, after, stints_sql
from isochron.sources.shared import stored

#: Names of the ratings, by design: the measure of a stint each is fitted to. Designs: net (home less away
#: members, net measure), sides (each side's attack against the other's defence), power (the larger side's attack, each
#: side's entries adding up to 1), event (one row an attempt); `+` fits score and zone effects too, which are left out.
METRICS = {
    "event": {"corsi_apm_5v5_event": "attempt"},
    "net+": {"corsi_rapm_5v5": "corsi", "goals_rapm_5v5": "goals", "primary_assist_rapm_5v5": "a1", "secondary_assist_rapm_5v5": "a2"},
    "net": {
        "xg_rapm_5v5": "xg",
        "hd_xg_rapm_5v5_ge020": "hd_xg",
        "xg_primary_assist_on_goals_rapm_5v5": "xg_a1",
        "xg_secondary_assist_on_goals_rapm_5v5": "xg_a2",
        "takeaway_to_xg_swing_rapm_5v5_w10": "takeaway_swing",
        "giveaway_to_xg_swing_rapm_5v5_w10": "giveaway_swing",
        "turnover_to_xg_swing_rapm_5v5_w10": "turnover_swing",
        "blocked_shot_to_xg_swing_rapm_5v5_w10": "block_swing",
        "faceoff_loss_to_xg_swing_rapm_5v5_w10": "faceoff_swing",
        "finishing_residual_rapm_5v5": "finishing",
    },
    "sides+": {"corsi_{}_rapm_5v5": "corsi"},
    "sides": {"xg_{}_rapm_5v5": "xg", "hd_xg_{}_rapm_5v5_ge020": "hd_xg", "penalties_{}_rapm_5v5": "penalties"},
    "power+": {"corsi_{}_rapm": "corsi"},
    "power": {"xg_{}_rapm": "xg", "hd_xg_{}_rapm_ge020": "hd_xg"},
}

#: What stands for {} in a name: for entries of attack and of defence.
SIDES = {"sides": ("off", "def"), "power": ("pp_off", "pk_def"), "penalties": ("committed", "drawn")}

#: Metrics of a window of games.
ROLLING = {
    "net": {"penalties_taken_rapm_5v5": "penalties", **{k: v for k, v in METRICS["net"].items() if v in ("turnover_swing", "takeaway_swing", "giveaway_swing")}},
    "sides": {"corsi_{}_rapm_5v5": "corsi", "xg_{}_rapm_5v5": "xg", "hd_xg_{}_rapm_5v5_ge020": "hd_xg"},
    "power": {"xg_{}_rapm": "xg", "corsi_{}_rapm": "corsi"},
}

#: Seconds that a member must have played, in a season and in a window.
SEASON_SECONDS, WINDOW_SECONDS = {"5v5": 600, "pp": 60}, {"5v5": 200, "pp": 60}

WINDOW_GAMES = 10

ROLLING_ALPHA = 1000.0

#: Places of games in blocks that are broadcast; more are joined by game.
MOST_PLACES = 200_000


def _variants(strength: str, metrics: dict[str, dict[str, str]]) -> Column:
    """The designs' rows of a stint, as an array: design, row_id, entries, targets (an hour)."""
    rate = lambda c: 3600.0 * F.col(c) / F.col("duration")

    def one(design: str, suffix: str, entries: Column, score: Column, prefix: str) -> Column:
        if design.endswith("+"):
            entries = F.concat(entries, G.effect_entries(score, F.col("zone")))
        ys = G.targets(**{name: rate(f"{prefix}_{measure}") for name, measure in metrics[design].items()})
        return F.struct(F.lit(design).alias("design"), F.concat("row_id", F.lit(suffix)).alias("row_id"), entries.alias("entries"), ys.alias("targets"))

    home, away, score = F.col("home_skaters"), F.col("away_skaters"), F.col("score_state")
    out = []
    for design in metrics:
        kind = design.rstrip("+")
        if strength == "5v5" and kind == "net":
            out.append(one(design, "", G.net_entries("home_skaters", "away_skaters"), score, "net"))
        elif strength == "5v5" and kind == "sides":
            out += [one(design, "/home", G.sided_entries(home, away), score, "home"), one(design, "/away", G.sided_entries(away, home), -score, "away")]
        elif strength == "pp" and kind == "power":
            sides = one(design, "", G.sided_entries(home, away, True), score, "home"), one(design, "", G.sided_entries(away, home, True), -score, "away")
            out.append(F.when(F.size(home) > F.size(away), sides[0]).otherwise(sides[1]))
    return F.array(*out)


def rated_rows(feed: Feed, metrics: dict[str, dict[str, str]], gated: bool = False) -> DataFrame:
    """season, game_id, strength, id, both sides' skaters, seconds, w and the designs' rows of each stint; attempts too if
    asked for, without seconds. `gated`: only of games that have passed their checks."""
    lineups, parts = only_passed(*judged(feed), ["game_id"]) if gated else stored(P.lineups(feed)), []
    for strength in ("5v5", "pp"):
        s = P.stints(P.filter_strength(lineups, strength)).withColumn("row_id", F.concat_ws("-", F.lit(strength), "game_id", "stint_id"))
        parts.append(s.select("season", "game_id", F.lit(strength).alias("strength"), F.col("row_id").alias("id"), "home_skaters", "away_skaters", F.col("duration").alias("seconds"), F.col("duration").cast("double").alias("w"), _variants(strength, metrics).alias("variants")))
    if "event" in metrics:
        e = P.filter_strength(lineups, "5v5").filter(F.col("event_type").isin(*P.SHOTS))
        row = F.concat_ws("-", F.lit("event"), "game_id", "event_id")
        sign = F.when(F.col("event_team_id") == F.col("home_team_id"), 1.0).otherwise(-1.0)
        own = F.struct(F.lit("event").alias("design"), row.alias("row_id"), G.net_entries("home_skaters", "away_skaters").alias("entries"), G.targets(**{name: sign for name in metrics["event"]}).alias("targets"))
        parts.append(e.select("season", "game_id", F.lit("5v5").alias("strength"), row.alias("id"), "home_skaters", "away_skaters", F.lit(0).cast("long").alias("seconds"), F.lit(1.0).alias("w"), F.array(own).alias("variants")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return stored(out)


def _seconds(rows: DataFrame, *keys: str) -> DataFrame:
    """Each member's seconds by keys."""
    return rows.select(*keys, "seconds", F.explode(F.concat("home_skaters", "away_skaters")).alias("player_id")).groupBy(*keys, "player_id").agg(F.sum("seconds").alias("toi"))


def _least(seconds: dict[str, int]) -> Column:
    return F.when(F.col("strength") == "5v5", seconds["5v5"]).otherwise(seconds["pp"])


def season_rows(feed: Feed, metrics: dict[str, dict[str, str]] = METRICS) -> DataFrame:
    """Rows of all designs, of stints whose members all have played enough in the season, with is_train: whether a row's
    game is among the first four fifths of the season's."""
    rows = rated_rows(feed, metrics, gated=True)
    exposure = _seconds(rows, "season", "strength")
    rows = R.min_exposure(rows, "id", ["home_skaters", "away_skaters"], exposure, "player_id", "toi", _least(SEASON_SECONDS), ["season", "strength"])
    games = R.time_split(feed.games.select("season", "game_id"), "game_id", 0.8, ["season"])
    last = games.filter("is_train").groupBy("season").agg(F.max("game_id").alias("_last"))
    rows = rows.join(F.broadcast(last), "season", "left").withColumn("is_train", F.coalesce(F.col("game_id") <= F.col("_last"), F.lit(False)))
    return stored(rows).select("season", "is_train", "w", F.explode("variants").alias("v")).select("season", "is_train", "w", "v.*")


def _named(fitted: DataFrame) -> DataFrame:
    """metric_name, player_id, value of coefficients: higher is better, so those of defence change their sign, but for
    penalties; effects are left out."""
    attack, power = F.col("name").startswith("off:"), F.col("design").startswith("power")
    penalties = F.col("target").startswith("penalties_{}")
    side = lambda i: F.when(power, SIDES["power"][i]).when(penalties, SIDES["penalties"][i]).otherwise(SIDES["sides"][i])
    sign = F.when(F.col("name").startswith("def:") & ~penalties, -1.0).otherwise(1.0)
    rows = fitted.filter(~F.col("name").startswith("fe:"))
    name = F.replace("target", F.lit("{}"), F.when(attack, side(0)).otherwise(side(1)))
    return rows.withColumns({"metric_name": name, "player_id": F.regexp_extract("name", "[0-9]+$", 0).cast("long"), "value": sign * F.col("coefficient")})


_SEASON = ["season", "design"]


def season_ratings(feed: Feed, metrics: dict[str, dict[str, str]] = METRICS) -> DataFrame:
    """season, metric_name, player_id, value of each season's fits, each at its own chosen penalty."""
    fitted = _named(season_fits(season_rows(feed, metrics)))
    return fitted.select("season", "metric_name", "player_id", "value")


def season_fits(rows: DataFrame) -> DataFrame:
    return G.fit_by_holdout(G.moments(rows, [*_SEASON, "is_train"]), _SEASON, "is_train")


def _target_rows(metrics: dict[str, dict[str, str]]) -> str:
    return ", ".join(f"('{design}', '{name}')" for design, own in metrics.items() for name in own)


_BOTH = LINEUPS + "," + stints_sql("stints", EVEN) + "," + stints_sql("uneven", UNEVEN)
_PASSED = "game_id IN (SELECT game_id FROM verdicts WHERE passed)"
_GATED = GATE + "," + stints_sql("stints", f"{EVEN} AND {_PASSED}") + "," + stints_sql("uneven", f"{UNEVEN} AND {_PASSED}")


def _kept(name: str, by: str, least: int, rows: str | None = None) -> str:
    """The stints (or rows like them, with their members) none of whose members is short of seconds."""
    short = f"SELECT {by}, player_id FROM {name}_members GROUP BY {by}, player_id HAVING sum(duration) < {least}"
    own = rows or name
    return f"(SELECT s.* FROM {own} s WHERE NOT EXISTS (SELECT 1 FROM ({short}) t WHERE t.{by} = s.{by} AND (list_contains(s.home_skaters, t.player_id) OR list_contains(s.away_skaters, t.player_id))))"


def _name_sql(keys: str, even: str, uneven: str, events: str | None) -> str:
    """design, keys and name of each entry that some kept row has."""
    larger = "CASE WHEN len(home_skaters) > len(away_skaters) THEN {} ELSE {} END"
    attack, defend = larger.format("home_skaters", "away_skaters"), larger.format("away_skaters", "home_skaters")
    state = f"CASE WHEN len(home_skaters) > len(away_skaters) THEN score_state ELSE -score_state END"
    everyone = "unnest(list_concat(home_skaters, away_skaters))"
    parts = [("net", f"CAST({everyone} AS VARCHAR)", even, ""), ("sides", f"'off:' || {everyone}", even, ""), ("sides", f"'def:' || {everyone}", even, ""), ("power", f"'off:' || unnest({attack})", uneven, ""), ("power", f"'def:' || unnest({defend})", uneven, "")]
    out = [f"SELECT '{d}{plus}' AS design, {keys}, {name} AS name FROM {rows}" for d, name, rows, _ in parts for plus in ("", "+")]
    effects = [("net", "score_state", even), ("sides", "score_state", even), ("sides", "-score_state", even), ("power", state, uneven)]
    out += [f"SELECT '{d}+', {keys}, 'fe:score' || {score} FROM {rows} WHERE score_state <> 0" for d, score, rows in effects]
    out += [f"SELECT '{d}+', {keys}, 'fe:zone' || zone FROM {rows} WHERE zone IN ('O', 'D')" for d, _, rows in effects]
    if events:
        out.append(f"SELECT 'event', {keys}, CAST({everyone} AS VARCHAR) FROM {events}")
    return " UNION ".join(out)


_SEASON_SQL = after(
    _GATED + f""",
even_kept AS {_kept("stints", "season", SEASON_SECONDS["5v5"])}, uneven_kept AS {_kept("uneven", "season", SEASON_SECONDS["pp"])},
attempts AS {_kept("stints", "season", SEASON_SECONDS["5v5"], f"(SELECT * FROM lineups WHERE {EVEN} AND {_PASSED} AND event_type IN ('SHOT', 'MISSED_SHOT', 'GOAL', 'BLOCKED_SHOT'))")},
names AS ({_name_sql("season", "even_kept", "uneven_kept", "attempts")}), targets AS (SELECT * FROM (VALUES {_target_rows(METRICS)}) v(design, target))""",
    "@@",
)


@query()
def g4_h_ratings(feed: Feed) -> DataFrame:
    """All ratings of each season, with the penalty that the season's last fifth of games chose."""
    fitted = _named(season_fits(season_rows(feed)))
    return fitted.select("season", "metric_name", "player_id", F.round("value", 6).alias("value"), F.round("alpha", 6).alias("alpha"))


@query(_SEASON_SQL.replace("@@", "SELECT season, target, name, CAST(0 AS DOUBLE) AS gap FROM names JOIN targets USING (design)"))
def h_normal_equations(feed: Feed) -> DataFrame:
    """Each coefficient's normal equation over the rows: 0 to six places of an hour's measure, by seconds of a season."""
    rows = season_rows(feed)
    gaps = G.normal_gaps(rows, stored(season_fits(rows)), _SEASON, "row_id")
    return gaps.select("season", "target", "name", F.abs(F.round(F.col("gap") / 1000, 6)).alias("gap"))


@query(_SEASON_SQL.replace("@@", f"SELECT DISTINCT season, target, CAST({len(G.ALPHAS)} AS BIGINT) AS alphas, CAST(1 AS BIGINT) AS chosen, true AS least, CAST(0 AS DOUBLE) AS gap FROM names JOIN targets USING (design) WHERE season IN (SELECT season FROM feed_games GROUP BY 1 HAVING count(*) > 1)"))
def g6_alpha_path(feed: Feed) -> DataFrame:
    """The held-out error of each penalty by one eigendecomposition; the chosen one's against errors of single rows. A season
    of one game has no games to train on."""
    rows = season_rows(feed)
    parts = stored(G.moments(rows, [*_SEASON, "is_train"]))
    path = G.holdout_path(parts, _SEASON, "is_train")
    chosen = path.groupBy(*_SEASON, "target").agg(F.count("*").alias("alphas"), F.count_if("best").alias("chosen"), F.min("error").alias("_least"), F.max(F.when(F.col("best"), F.col("error"))).alias("_error"), F.max(F.when(F.col("best"), F.col("alpha"))).alias("_alpha"))
    chosen = stored(chosen)
    refit = _at_alphas(parts.filter("is_train"), chosen)
    left = G.residuals(_padded(rows.filter("NOT is_train")), refit, _SEASON, "row_id", "w")
    direct = left.groupBy(*_SEASON, "target").agg((F.sum(F.col("w") * F.col("residual") ** 2) / F.sum("w")).alias("_direct"))
    out = chosen.join(direct, [*_SEASON, "target"])
    return out.select("season", "target", "alphas", "chosen", (F.col("_least") == F.col("_error")).alias("least"), F.abs(F.round(F.col("_direct") / F.col("_error") - 1, 6)).alias("gap"))


def _padded(rows: DataFrame) -> DataFrame:
    """Rows with an entry that every fit has, so that a row whose own names were never trained has its intercept."""
    return rows.withColumn("entries", F.concat("entries", F.array(G.entry(F.lit("fe:always"), 0.0))))


def _at_alphas(parts: DataFrame, chosen: DataFrame) -> DataFrame:
    """Coefficients of each target at its own penalty, with a name of no weight that each row may have."""
    import pyarrow as pa
    from pyspark.sql.types import StructType

    schema = StructType([*parts.select(*_SEASON).schema.fields, *StructType.fromDDL("target string, name string, coefficient double, intercept double").fields])

    def solve(key, table, alphas):
        own = G.System(*G._arrays(table))
        rows = []
        for target, alpha in zip(alphas["target"].to_pylist(), alphas["_alpha"].to_pylist()):
            b, b0 = own.solve(target, alpha)
            rows += [(*[k.as_py() for k in key], target, name, float(x), b0) for name, x in [*zip(own.names.to_pylist(), b), ("fe:always", 0.0)]]
        return pa.table([list(c) for c in zip(*rows)] if rows else [[] for _ in schema], names=schema.fieldNames())

    return parts.groupBy(*_SEASON).cogroup(chosen.groupBy(*_SEASON)).applyInArrow(solve, schema)


_CG_ALPHA = 100.0


def _pooled(feed: Feed) -> DataFrame:
    return season_rows(feed, {"net+": {"corsi_rapm_5v5": "corsi"}})


@query(_SEASON_SQL.replace("@@", "SELECT DISTINCT name, CAST(0 AS DOUBLE) AS gap FROM names WHERE design = 'net+'"))
def g4_conjugate_gradient(feed: Feed) -> DataFrame:
    """All seasons pooled: the matrix-free solution against the dense one."""
    rows = _pooled(feed)
    dense = G.fit(G.moments(rows, []).withColumn("all", F.lit(1)), ["all"], _CG_ALPHA)
    free = G.conjugate_gradient(rows, "corsi_rapm_5v5", _CG_ALPHA).select("name", F.col("coefficient").alias("free"))
    return dense.join(free, "name", "full").select("name", F.abs(F.round(F.col("coefficient") - F.col("free"), 6)).alias("gap"))


@query()
def g5_ridge_loo(feed: Feed) -> DataFrame:
    rows = _pooled(feed)
    return G.leave_one_out(rows, G.moments(rows, []), "corsi_rapm_5v5", [10.0, 100.0, 1000.0])


@query()
def g11_bootstrap(feed: Feed) -> DataFrame:
    """Twenty Poisson replicates of each season's net attempts."""
    out = G.bootstrap(_pooled(feed), ["season"], "row_id", _CG_ALPHA, 20)
    return out.filter(~F.col("name").startswith("fe:")).select("season", F.col("name").cast("long").alias("player_id"), *[F.round(c, 4).alias(c) for c in ("mean", "std", "low", "high")])


@query(_SEASON_SQL.replace(" @@", """, tallies AS (SELECT 'net' AS kind, season, count(*) AS n FROM even_kept GROUP BY 2 UNION ALL SELECT 'sides', season, 2 * count(*) FROM even_kept GROUP BY 2
  UNION ALL SELECT 'power', season, count(*) FROM uneven_kept GROUP BY 2 UNION ALL SELECT 'event', season, count(*) FROM attempts GROUP BY 2)
SELECT season, target, n, CAST(0 AS DOUBLE) AS mean, true AS spread FROM tallies JOIN targets ON kind = replace(design, '+', '')"""))
def g12_residuals(feed: Feed) -> DataFrame:
    """Residuals of all ratings: their weighted mean is 0, as the intercept isn't penalised."""
    rows = season_rows(feed)
    left = G.residuals(rows, stored(season_fits(rows)), _SEASON, "row_id", "w")
    mean = F.sum(F.col("w") * F.col("residual")) / F.sum("w")
    out = left.groupBy("season", "target").agg(F.count("*").alias("n"), F.abs(F.round(mean, 6)).alias("mean"), (F.stddev_samp("residual") >= 0).alias("spread"))
    return out


def window_fits(feed: Feed, games: int = WINDOW_GAMES, stride: int = 1) -> DataFrame:
    """Fits of each window of games over the rows whose members all have played enough in it. Rows are dealt once to blocks
    of neighbouring windows, a task takes a block's windows one by one, and only coefficients leave it."""
    blocks = A.window_blocks(feed.games.select("season", "game_id"), ["season"], ["game_id"], games, stride).drop("season")
    blocks = F.broadcast(blocks) if blocks.count() <= MOST_PLACES else blocks
    rows = rated_rows(feed, ROLLING).withColumns({"members": F.concat("home_skaters", "away_skaters"), "kind": F.col("strength"), "least": _least(WINDOW_SECONDS)}).join(blocks, "game_id")
    return G.fit_windows(rows.select("season", "block", "first", "last", "place", "kind", "members", "seconds", "least", "w", "variants"), ["season"], games, stride, ROLLING_ALPHA)


def window_parts(feed: Feed, games: int = WINDOW_GAMES, stride: int = 1) -> tuple[DataFrame, DataFrame]:
    """Moments by season, window of games and design, and the rows they stand for: the systems of `window_fits` by joins, for
    tests to hold against them, as these moments take many times the rows' disk. Each game's moments are made once and
    summed into its windows; rows with a member short of seconds in a window are few, and are subtracted there."""
    rows = rated_rows(feed, ROLLING)
    windows = A.count_windows(feed.games.select("season", "game_id"), ["season"], ["game_id"], games, stride).select("game_id", "window_id")
    keys = ["season", "window_id", "design"]
    whole = G.moments(rows.select("season", "game_id", "w", F.explode("variants").alias("v")).select("season", "game_id", "w", "v.*"), ["season", "game_id", "design"])
    summed = whole.join(windows, "game_id").select(*keys, "a", "b", "s")
    exposure = _seconds(rows, "season", "game_id", "strength").join(windows, "game_id").groupBy("season", "window_id", "strength", "player_id").agg(F.sum("toi").alias("toi"))
    short = exposure.filter(F.col("toi") < _least(WINDOW_SECONDS)).select("season", "window_id", "strength", "player_id")
    members = rows.select("season", "game_id", "strength", "id", F.explode(F.concat("home_skaters", "away_skaters")).alias("player_id")).join(windows, "game_id")
    gone = members.join(short, ["season", "window_id", "strength", "player_id"], "left_semi").select("id", "window_id").distinct()
    each = lambda df: df.select("season", "window_id", "w", F.explode("variants").alias("v")).select("season", "window_id", "w", "v.*")
    less = G.moments(each(rows.join(gone, "id").withColumn("w", -F.col("w"))), keys)
    kept = each(rows.join(windows, "game_id").join(gone, ["id", "window_id"], "left_anti"))
    return stored(G.added(summed.unionByName(less), keys)), kept


def _only_kept(parts: DataFrame) -> DataFrame:
    """Without the names of which all rows were subtracted: seconds are whole, so theirs add up to exactly 0."""
    keys = ["season", "window_id", "design"]
    gone = parts.filter((F.col("a") == F.col("b")) & (F.col("a") != G.INTERCEPT) & ~F.col("a").startswith("=") & (F.abs("s") < 1e-6)).select(*keys, F.col("a").alias("_n"))
    for side in ("a", "b"):
        parts = parts.join(gone.withColumnRenamed("_n", side), [*keys, side], "left_anti")
    return parts


@query()
def h18_rolling_ratings(feed: Feed) -> DataFrame:
    """Ratings of each window of ten games; each window's systems are solved in tasks."""
    fitted = _named(window_fits(feed))
    return fitted.select("season", "window_id", "metric_name", "player_id", F.round("value", 6).alias("value"))


def _window_sql() -> str:
    windows = "windows AS (SELECT season, game_id, unnest(generate_series(CAST(greatest(ceil((i - 5) / 2.0), 0) AS BIGINT), CAST(least(floor((i - 1) / 2.0), floor((n - 5) / 2.0)) AS BIGINT))) AS window_id FROM (SELECT season, game_id, row_number() OVER (PARTITION BY season ORDER BY game_id) AS i, count(*) OVER (PARTITION BY season) AS n FROM feed_games) WHERE greatest(ceil((i - 5) / 2.0), 0) <= least(floor((i - 1) / 2.0), floor((n - 5) / 2.0)))"

    def kept(name: str, least: int) -> str:
        own = f"SELECT season || '/' || window_id AS place, {name}.* FROM {name} JOIN windows w USING (season, game_id)"
        short = f"SELECT season || '/' || window_id AS place, player_id FROM {name}_members JOIN windows USING (season, game_id) GROUP BY 1, 2 HAVING sum(duration) < {least}"
        return f"(SELECT s.* FROM ({own}) s WHERE NOT EXISTS (SELECT 1 FROM ({short}) t WHERE t.place = s.place AND (list_contains(s.home_skaters, t.player_id) OR list_contains(s.away_skaters, t.player_id))))"

    return after(
        _BOTH + f""", {windows}, even_kept AS {kept("stints", WINDOW_SECONDS["5v5"])}, uneven_kept AS {kept("uneven", WINDOW_SECONDS["pp"])},
names AS ({_name_sql("place", "even_kept", "uneven_kept", None)}), targets AS (SELECT * FROM (VALUES {_target_rows(ROLLING)}) v(design, target))""",
        "SELECT split_part(place, '/', 1) AS season, CAST(split_part(place, '/', 2) AS BIGINT) AS window_id, target, name, CAST(0 AS DOUBLE) AS gap FROM names JOIN targets USING (design)",
    )


@query(_window_sql())
def h18_normal_equations(feed: Feed) -> DataFrame:
    """Windows of five games, every second one: each coefficient's normal equation over the rows that its window keeps."""
    gap = F.abs(F.round(F.col("gap") / 1000, 6)).alias("gap")
    return window_fits(feed, 5, 2).select("season", "window_id", "target", "name", gap)
