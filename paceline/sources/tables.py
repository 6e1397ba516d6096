"""Readers of the driver tables and the typed fact tables of the rating engine that are derived from them."""

from __future__ import annotations

import csv
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A line item's place in its order; (l_orderkey, l_linenumber) alone isn't unique.
LINE_ORDER = ("l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice")
#: Games of one period are played in this order.
CHRONOLOGY = ("season", "st_order", "week", "start_date", "game_id")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, paths: list[str] | str, schema: str) -> DataFrame:
    """CSV files, gzip included, of a fixed schema, with ``file_year``: what stands after the last ``_`` of the file's name."""
    rows = spark.read.csv(paths, schema=schema, header=True)
    return rows.withColumn("file_year", F.regexp_extract(F.col("_metadata.file_name"), r"_(\d+)\.csv(?:\.gz)?$", 1).try_cast("int"))


def read_existing(spark: SparkSession, pattern: str) -> DataFrame:
    """Parquet files by a glob; files that vanish meanwhile are skipped."""
    return spark.read.option("ignoreMissingFiles", "true").parquet(pattern)


def write_partitioned(df: DataFrame, path: str, by: str = "season") -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def write_csv(df: DataFrame, path: str, compressed: bool = False) -> None:
    """A small table as one CSV file with a header; ``compressed`` for large ones, which keep their partitions."""
    out = df if compressed else df.coalesce(1)
    out.write.mode("overwrite").csv(path, header=True, compression="gzip" if compressed else "none")


def cached(spark: SparkSession, path: str, build, force: bool = False) -> DataFrame:
    """Read-through: the table at ``path`` if it is complete and not ``force``; else built and written first."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if force or not mark.getFileSystem(conf).exists(mark):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set and executors are threads of this machine, a
    temporary one is made; on a cluster that is an error."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError(f"spark.checkpoint.dir isn't set, and executors of {sc.master} share no folder of this machine")
        path = tempfile.mkdtemp(prefix="paceline-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Plans made herein leave no shuffle files when they have run: what they wrote stands elsewhere by then."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def staged(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint, for a result that several parts of a plan use: cuts the plan, survives lost executors, and
    goes with its last user, unlike a cache."""
    shared_folder(df.sparkSession)
    with tidied(df.sparkSession):
        return df.select("*").checkpoint()  # a plan of its own: no one else needs its shuffles


def partitioned(df: DataFrame, by: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, a folder for each value of ``by``: who asks for one reads it alone."""
    path = f"{shared_folder(df.sparkSession)}/by-{by}-{uuid.uuid4().hex}"
    with tidied(df.sparkSession):
        write_partitioned(df.repartition(by), path, by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, *by: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, for a table that several parts of a plan scan: smaller than a
    checkpoint, and columns or folders ``by`` a value that a part doesn't ask for aren't read."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    with tidied(df.sparkSession):
        df.select("*").write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def report(lines: list[str], path: str | None = None) -> str:
    """A text report, printed and, if ``path`` is given, written: a few lines that are on the driver anyway."""
    text = "\n".join(lines)
    print(text)
    if path:
        Path(path).write_text(text + "\n", encoding="utf-8")
    return text


def read_drifting(spark: SparkSession, paths: list[str], schemas: list[str]) -> DataFrame:
    """CSV files of schemas that differ, by name: a column that a file lacks is null there."""
    parts = [read_csv(spark, p, s) for p, s in zip(paths, schemas, strict=True)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def discovered(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """CSV files, gzip included, of whatever columns each has: by name, a column that a file lacks null there, with ``file_year``.

    One job finds every file's header; files of one header are one scan, as text; one more job over all of them finds
    which columns are whole numbers or numbers throughout. A name that a header repeats is numbered, an empty one is
    named by its place. Files without a line have no rows.
    """
    at = F.col("_metadata.file_block_start")
    lines = spark.read.text(paths).where(at == 0).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))
    heads: dict[tuple[str, ...], list[str]] = {}
    for r in lines.groupBy("file").agg(F.min_by("value", "row").alias("header")).collect():  # a row a file
        heads.setdefault(tuple(_names(r["header"])), []).append(r["file"])
    if not heads:
        return spark.createDataFrame([], "file_year int")
    parts = [read_csv(spark, sorted(files), ", ".join(f"`{n}` string" for n in names)) for names, files in sorted(heads.items())]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    names = [c for c in rows.columns if c != "file_year"]
    odd = lambda n, kind: F.count_if(F.col(f"`{n}`").isNotNull() & F.trim(f"`{n}`").try_cast(kind).isNull())
    found = rows.agg(*[odd(n, kind).alias(f"{k}{kind}") for k, n in enumerate(names) for kind in ("bigint", "double")]).first()
    kind = {n: next((t for t in ("bigint", "double") if not found[f"{k}{t}"]), "string") for k, n in enumerate(names)}
    return rows.select(*[F.col(f"`{n}`") if kind[n] == "string" else F.trim(f"`{n}`").try_cast(kind[n]).alias(n) for n in names], "file_year")


def _names(header: str) -> list[str]:
    out: list[str] = []
    for k, name in enumerate(next(csv.reader([header.removeprefix("\ufeff")]), [])):
        name = name.strip().replace("`", "'") or f"_c{k}"
        out.append(name if name not in out else f"{name}_{k}")
    return out


def numeric(c: Column) -> Column:
    """Text as a number, null where it isn't one."""
    return c.try_cast("double")


def instant(c: Column) -> Column:
    """Text as a time in UTC, null where it isn't one."""
    return F.try_to_timestamp(c)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` without the rows whose key ``new`` has, and then ``new``."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def ranked_items(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER, "l_returnflag", *extra)
    return items.withColumn("rn", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a team: key, division, conference, pre-season rating."""
    s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    s = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    division = F.when(F.col("s_nationkey") % 5 != 0, "fbs").otherwise("fcs")
    elo = F.when(F.col("s_suppkey") % 17 != 0, 1500 + F.col("s_acctbal") / 20)
    return s.select("s_suppkey", division.alias("division"), F.col("r_name").alias("conference"), elo.alias("pregame_elo"))


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed games without ties: the first line item of an order is the home side, the second the away side."""
    rows = ranked_items(spark, sf_dir).where("rn <= 2").groupBy("l_orderkey")
    side = lambda k, c: F.max(F.when(F.col("rn") == k, F.col(c)))
    pairs = rows.agg(side(1, "l_suppkey").alias("h"), side(2, "l_suppkey").alias("a"), side(1, "l_quantity").cast("int").alias("home_points"), side(2, "l_quantity").cast("int").alias("away_points"), (side(1, "l_returnflag") == "R").alias("neutral_site"))
    pairs = pairs.where("h <> a and home_points <> away_points")
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("start_date"))
    g = pairs.join(orders, "l_orderkey")
    teams = suppliers(spark, sf_dir)
    for key, name in (("h", "home"), ("a", "away")):
        g = g.join(teams.select(F.col("s_suppkey").alias(key), *[F.col(c).alias(f"{name}_{c}") for c in ("division", "conference", "pregame_elo")]), key)
    w = F.least(F.floor((F.dayofyear("start_date") - 1) / 7) + 1, F.lit(52)).cast("int")
    g = g.withColumn("w", w)
    return g.select(
        F.col("l_orderkey").alias("game_id"), F.year("start_date").alias("season"), F.when(F.col("w") <= 48, F.col("w")).otherwise(F.col("w") - 48).cast("int").alias("week"),
        (F.col("w") > 48).cast("int").alias("st_order"), F.when(F.col("w") <= 48, "regular").otherwise("postseason").alias("season_type"), "start_date",
        F.concat(F.lit("S"), "h").alias("home_team"), F.concat(F.lit("S"), "a").alias("away_team"), "home_points", "away_points", "neutral_site",
        "home_division", "away_division", "home_conference", "away_conference", (F.col("home_conference") == F.col("away_conference")).alias("conference_game"),
        "home_pregame_elo", "away_pregame_elo", (F.col("home_points") > F.col("away_points")).cast("int").alias("home_win"), (F.col("home_points") - F.col("away_points")).alias("margin"),
    )


def periods(g: DataFrame) -> DataFrame:
    """The walk-forward clock: a dense number for each (season, st_order, week); a few hundred rows."""
    keys = g.select("season", "st_order", "week").distinct()
    return keys.withColumn("period", F.row_number().over(Window.orderBy("season", "st_order", "week")) - 1)


def timed_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The games with their periods: derived once and stored, as most queries scan them several times."""
    g = stored(games(spark, sf_dir))
    return g.join(F.broadcast(periods(g)), ["season", "st_order", "week"])  # a row a period


def line_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Betting lines by game, book and side: the remaining line items of an order that is a game.

    Both sides of the game come from windows over the order that the ranking needs anyway, not from a join.
    """
    items = ranked_items(spark, sf_dir, "l_discount", "l_tax", "l_linestatus")
    order = Window.partitionBy("l_orderkey")
    of = lambda k, c: F.max(F.when(F.col("rn") == k, F.col(c))).over(order)
    items = items.withColumns({"h": of(1, "l_suppkey"), "a": of(2, "l_suppkey"), "hq": of(1, "l_quantity"), "aq": of(2, "l_quantity")}).where("rn >= 3 and h <> a and hq <> aq")
    even = F.col("l_linenumber") % 2 == 0
    lines = F.round((F.col("l_discount") - 0.05) * 200 * F.when(even, 1).otherwise(-1), 2)
    return items.select(
        F.col("l_orderkey").alias("game_id"), F.when(even, "home").otherwise("away").alias("side"), lines.alias("lines"),
        F.when(F.col("l_returnflag") != "N", F.round((F.col("l_tax") - 0.04) * 200, 2)).alias("opening_lines"),
        F.when(F.col("l_linestatus") == "F", -110 - F.col("l_quantity")).otherwise(100 + F.col("l_quantity")).alias("odds"),
        F.when(F.col("l_partkey") % 2 == 0, "spread").otherwise("money_line").alias("market_type"),
        F.concat(F.lit("S"), "h").alias("home_team"), F.concat(F.lit("S"), "a").alias("away_team"), F.concat(F.lit("B"), F.when(even, F.col("h")).otherwise(F.col("a"))).alias("abbr"),
    )


#: Who did what in a play, by column of their ids: offence, the ball lost, defence, and who caught.
OFFENCE = ("rush", "completion", "incompletion", "sack_taken", "interception_thrown")
DEFENCE = ("sack", "interception", "pass_breakup", "fumble_forced")
ROLES = (*OFFENCE, "fumble", "fumble_recovered", *DEFENCE, "reception")


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Play-by-play rows as files of them are: the ids of those who did something, their yards, down and distance; any
    of these may be missing."""
    e = read(spark, sf_dir, "events")
    one, kind, n = F.col("user_id"), F.col("event_type"), F.col("event_id")
    other = one + 1 - 2 * (one % 2)
    yards, fumble = F.floor(F.col("value") / 10), F.col("value") > 200
    on = lambda k, who: F.when(kind == k, who)
    ids = {
        "rush": on("purchase", one), "completion": on("view", one), "incompletion": on("click", one), "sack_taken": on("error", one), "interception_thrown": on("signup", one),
        "fumble": F.when(fumble, one + 10), "fumble_recovered": F.when(fumble & (n % 3 == 1), other).when(fumble & (n % 3 == 2), one),
        "sack": on("error", other), "interception": on("signup", other), "pass_breakup": F.when((kind == "click") & (n % 5 == 0), other), "fumble_forced": F.when(fumble & (n % 2 == 0), other),
        "reception": on("view", one + 10), "touchdown": F.when((n % 10 == 0) & kind.isin("purchase", "view"), one),
    }
    return e.select(
        "event_id", (F.floor(n / 1000) * 5 + F.floor(one % 10 / 2)).cast("long").alias("game_id"), (F.lit(2014) + F.floor(F.dayofmonth("ts") / 6)).cast("int").alias("season"), (F.floor((F.dayofmonth("ts") % 6 * 24 + F.hour("ts")) / 3) + 1).cast("int").alias("week"), *[c.alias(f"{r}_player_id") for r, c in ids.items()],
        on("purchase", yards).alias("rush_yds"), F.when((kind == "view") & (n % 7 != 0), yards).alias("completion_yds"), on("view", yards).alias("reception_yds"), on("error", yards).alias("sack_taken_stat"),
        F.when(n % 9 != 0, n % 4 + 1).cast("int").alias("down"), F.when(n % 8 != 0, 10 - n % 11).cast("int").alias("distance"),
    )


def rosters(spark: SparkSession, sf_dir: str) -> DataFrame:
    athletes = read(spark, sf_dir, "events").select(F.col("user_id").alias("athlete_id")).distinct()
    seasons = plays(spark, sf_dir).select("season").distinct()
    # An athlete is missing from every seventh season's roster.
    both = athletes.join(F.broadcast(seasons))  # a row a season
    return both.where("athlete_id % 7 <> season % 7").select("season", "athlete_id", (F.col("athlete_id") % 10).cast("int").alias("team"))


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction markets as a file of them has it: price, liquidity and end as text that may not be any, settlement as
    a list's text."""
    p = read(spark, sf_dir, "part")
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.median("l_extendedprice").alias("liquidity"), F.max("l_shipdate").alias("end"))
    m = p.join(lines, "p_partkey", "left")
    k = F.col("p_partkey")
    return m.select(
        k.alias("market_id"), F.col("p_type").alias("category"), F.when(k % 13 == 0, "n/a").otherwise((F.col("p_size") / 50).cast("string")).alias("last_trade_price"), (k % 3 != 0).cast("int").alias("active"),
        F.col("liquidity").cast("string").alias("liquidity"), F.when(k % 11 == 0, "soon").otherwise(F.date_format("end", "yyyy-MM-dd HH:mm:ss")).alias("end_date"),
        F.when(F.col("p_retailprice") > 960, "['1','0']").when(F.col("p_retailprice") > 920, "['0','1']").otherwise("n/a").alias("outcome_prices"),
    )


def market_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traded prices by market and outcome."""
    flag = F.col("l_returnflag")
    outcome = F.when(flag == "N", "Yes").when(flag == "A", "YES").otherwise("No")
    return read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("market_id"), outcome.alias("outcome"), F.round(F.col("l_discount") * 10, 4).alias("price"))


def six(c: Column) -> Column:
    """Six decimals, no negative zero."""
    return F.round(c, 6) + F.lit(0.0)
