"""Box scores, production, returning production, continuity and travel from play-by-play rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.functions.scalar import haversine_km, utc_offset
from paceline.sources.tables import DEFENCE, OFFENCE, ROLES

def teams_of(rosters: DataFrame) -> DataFrame:
    """(season, athlete_id, team): the first team by name of an athlete who is on several rosters."""
    return rosters.groupBy("season", "athlete_id").agg(F.min("team").alias("team"))


def attributed(plays: DataFrame, rosters: DataFrame) -> DataFrame:
    """``plays`` with the team of everyone in it as ``<role>_team``, null for who isn't on the season's roster.

    All roles of a play meet the roster in one join of long rows.
    """
    who = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"{r}_player_id").alias("athlete_id")) for r in ROLES])).alias("w")
    long = plays.select("event_id", "season", who).select("event_id", "season", "w.*").where("athlete_id is not null").join(teams_of(rosters), ["season", "athlete_id"])
    wide = long.groupBy("event_id").agg(*[F.max(F.when(F.col("role") == r, F.col("team"))).alias(f"{r}_team") for r in ROLES])
    return plays.join(wide, "event_id", "left")


def play_flags(plays: DataFrame) -> DataFrame:
    """What each attributed play counts for, and ``team``, the side on offence: of the first of its offensive roles whose
    team is known, or else of who fumbled."""
    has = lambda r: F.col(f"{r}_player_id").isNotNull()
    rush, thrown = has("rush"), has("completion") | has("incompletion") | has("interception_thrown")
    sacked = has("sack_taken") & ~rush & ~thrown
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    play = rush | thrown | sacked
    gain = F.when(rush, zero("rush_yds")).when(has("completion"), zero("completion_yds")).when(sacked, -zero("sack_taken_stat")).otherwise(0)
    down, distance = F.coalesce("down", F.lit(1)), F.coalesce("distance", F.lit(10))
    need = F.when(down == 1, 0.5).when(down == 2, 0.7).otherwise(1.0) * distance
    lost = F.when(has("fumble") & F.col("fumble_recovered_team").isNotNull(), F.coalesce(F.col("fumble_recovered_team") != F.col("fumble_team"), F.lit(True)).cast("double")).when(has("fumble"), 0.5).otherwise(0.0)
    number = lambda c: c.cast("int")
    return plays.withColumns({
        "team": F.coalesce(*[f"{r}_team" for r in OFFENCE], "fumble_team"), "play": number(play), "gain": F.when(play, gain).otherwise(0),
        "success": number((gain >= need) & (distance > 0) & play), "explosive": number(rush & (gain >= 12) | thrown & (gain >= 20)),
        "passed": number(thrown), "rushed": number(rush), "sacked": number(has("sack_taken")), "thrown_away": number(has("interception_thrown")), "lost": lost, "scored": number(has("touchdown")),
    })


#: Sums of a box score by the flags they are of, and counts of defensive roles.
OFFENSIVE = {"plays": "play", "yards": "gain", "successes": "success", "explosives": "explosive", "passes": "passed", "rushes": "rushed", "sacks_taken": "sacked", "picks_thrown": "thrown_away", "fumbles_lost": "lost", "touchdowns": "scored"}
DEFENSIVE = dict(zip(("sacks", "picks", "breakups", "forced"), DEFENCE, strict=True))


def box_scores(plays: DataFrame, rosters: DataFrame) -> DataFrame:
    """One row per game and team on offence: sums of its plays, and what its defenders did to the other's.

    A play counts for its team's offence and for each defender's team; all are sums of one stacked frame, not joins.
    """
    f = play_flags(attributed(plays, rosters))
    none = {n: F.lit(0) for n in (*OFFENSIVE, *DEFENSIVE)} | {"fumbles_lost": F.lit(0.0)}
    row = lambda team, own, some: F.struct(F.col(team).alias("team"), F.lit(own).alias("own"), *[c.alias(n) for n, c in (none | some).items()])
    parts = [row("team", 1, {n: F.col(c) for n, c in OFFENSIVE.items()}), *[row(f"{r}_team", 0, {n: F.lit(1)}) for n, r in DEFENSIVE.items()]]
    rows = f.select("season", "game_id", F.explode(F.array(*parts)).alias("x")).select("season", "game_id", "x.*").where("team is not null")
    out = rows.groupBy("season", "game_id", "team").agg(F.sum("own").alias("own"), *[F.sum(n).alias(n) for n in (*OFFENSIVE, *DEFENSIVE)])
    return out.where("own > 0").drop("own")


def with_allowed(box: DataFrame) -> DataFrame:
    """Each row with the other team's offence as what it allowed; teams alone in a game drop out."""
    opp = box.select("season", "game_id", F.col("team").alias("opp"), *[F.col(c).alias(f"{c}_allowed") for c in OFFENSIVE])
    return box.join(opp, ["season", "game_id"]).where("team <> opp")


def efficiency_margins(box: DataFrame, least: int = 20) -> DataFrame:
    """Per game the even team's rates a play minus the other's, where both have ``least`` plays; turnovers are the other's
    minus its own, havoc is sacks, breakups and forced fumbles a play of the other's."""
    both = box.join(box.select("season", "game_id", *[F.col(c).alias(f"{c}_2") for c in ("team", *OFFENSIVE, *DEFENSIVE)]), ["season", "game_id"])
    both = both.where((F.col("team") % 2 == 0) & (F.col("team_2") == F.col("team") + 1) & (F.col("plays") >= least) & (F.col("plays_2") >= least))
    rate = lambda c: F.col(c) / F.col("plays") - F.col(f"{c}_2") / F.col("plays_2")
    lost = lambda s: F.col(f"picks_thrown{s}") + F.col(f"fumbles_lost{s}")
    havoc = lambda s: F.col(f"sacks{s}") + F.col(f"breakups{s}") + F.col(f"forced{s}")
    made = {c: rate(c) for c in ("yards", "successes", "explosives")} | {"turnovers": lost("_2") - lost(""), "havoc": havoc("") / F.col("plays_2") - havoc("_2") / F.col("plays")}
    return both.select("season", "game_id", "team", F.col("team_2").alias("opp"), (F.col("plays") + F.col("plays_2")).alias("plays_total"), *[c.alias(f"{n}_margin") for n, c in made.items()])


def production(plays: DataFrame, rosters: DataFrame) -> DataFrame:
    """Yards (rushing, passing, receiving) and defensive plays of each athlete on a season's roster."""
    one = lambda r, yards, n: F.struct(F.col(f"{r}_player_id").alias("athlete_id"), yards.cast("long").alias("off_yards"), F.lit(n).alias("def_plays"))
    gained = [one(r, F.coalesce(F.col(f"{r}_yds"), F.lit(0)), 0) for r in ("rush", "completion", "reception")]
    rows = plays.select("season", F.explode(F.array(*gained, *[one(r, F.lit(0), 1) for r in DEFENCE])).alias("x")).select("season", "x.*").where("athlete_id is not null")
    sums = rows.groupBy("season", "athlete_id").agg(F.sum("off_yards").alias("off_yards"), F.sum("def_plays").alias("def_plays"))
    return sums.join(teams_of(rosters), ["season", "athlete_id"]).select("season", "team", "athlete_id", "off_yards", "def_plays")


def returning(plays: DataFrame, rosters: DataFrame) -> DataFrame:
    """Share of last season's production that is on this season's roster."""
    now = rosters.select("season", "team", "athlete_id", F.lit(True).alias("back"))
    last = production(plays, rosters).withColumn("season", F.col("season") + 1)
    seasons = rosters.select("season").distinct()
    rows = last.join(F.broadcast(seasons), "season", "left_semi").join(now, ["season", "team", "athlete_id"], "left")  # a row a season
    kept = lambda c: F.sum(F.when(F.col("back"), F.col(c)).otherwise(0)) / F.greatest(F.sum(c), F.lit(1))
    return rows.groupBy("season", "team").agg(kept("off_yards").alias("ret_off"), kept("def_plays").alias("ret_def"))


def continuity(rosters: DataFrame) -> DataFrame:
    """Athletes on both this and last season's roster over last season's; 0 for a team whose athletes all left."""
    last = rosters.select((F.col("season") + 1).alias("season"), "team", "athlete_id")
    now = rosters.select("season", "team", "athlete_id", F.lit(1).alias("here"))
    seasons = rosters.select("season").distinct()
    last = last.join(F.broadcast(seasons), "season", "left_semi")  # a row a season
    both = last.join(now, ["season", "team", "athlete_id"], "left").groupBy("season", "team").agg(F.count("here").alias("stay"), F.count("*").alias("n"))
    return both.select("season", "team", (F.col("stay") / F.col("n")).alias("roster_continuity"))


def placed(sides: DataFrame, venues: DataFrame) -> DataFrame:
    """``sides(season, team)`` with their venue of the season or, where a season has none, of the team's first season."""
    names = ("lat", "lon", "zone", "elev")
    own = venues.select("season", "team", F.struct(*names).alias("own"))
    first = venues.groupBy("team").agg(F.min_by(F.struct(*names), "season").alias("any"))
    x = sides.join(own, ["season", "team"], "left").join(first, "team", "left").withColumn("v", F.coalesce("own", "any"))
    return x.select("season", "team", "v.*")


def travel(trips: DataFrame) -> DataFrame:
    """``trips`` with neutral_site and home_/away_ lat, lon, zone, elev: km, hours and metres of the away side's way.

    All are 0 at neutral sites and where a side's place is unknown; hours are 0 where a zone is, metres count an unknown
    height as 0.
    """
    km = haversine_km(F.col("away_lat"), F.col("away_lon"), F.col("home_lat"), F.col("home_lon"))
    known = ~F.col("neutral_site") & F.col("home_lat").isNotNull() & F.col("away_lat").isNotNull()
    hours = F.coalesce(utc_offset(F.col("home_zone")) - utc_offset(F.col("away_zone")), F.lit(0))
    climb = F.coalesce("home_elev", F.lit(0)) - F.coalesce("away_elev", F.lit(0))
    return trips.withColumns({"km": F.when(known, km).otherwise(0.0), "tz_diff": F.when(known, hours).otherwise(0), "climb": F.when(known, climb).otherwise(0)})
