"""Nested JSON documents to rows, with explicit schemas.

Each ``read_*`` parses files; the matching flattening function takes a frame of parsed
documents, so documents that arrive another way (a string column, a stream) use it too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formbook.functions.text import canonical_list, fraction_parts, to_utc

_GOALIE = (
    "array<struct<playerId: bigint, name: struct<default: string>, starter: string, saves: int, shotsAgainst: int, "
    "goalsAgainst: int, savePctg: double, toi: string, evenStrengthShotsAgainst: string, powerPlayShotsAgainst: string, "
    "shorthandedShotsAgainst: string>>"
)
_SKATER = "array<struct<playerId: bigint, name: struct<default: string>, sog: int>>"
_SIDE = f"struct<goalies: {_GOALIE}, forwards: {_SKATER}, defense: {_SKATER}>"
_TEAM = "struct<abbrev: string, score: int, sog: int>"

BOX_SCORE = (
    f"id bigint, gameDate string, season int, homeTeam {_TEAM}, awayTeam {_TEAM}, "
    f"playerByGameStats struct<homeTeam: {_SIDE}, awayTeam: {_SIDE}>"
)
PLAY_BY_PLAY = (
    "id bigint, season int, homeTeam struct<id: bigint, abbrev: string>, awayTeam struct<id: bigint, abbrev: string>, "
    "plays array<struct<eventId: bigint, typeDescKey: string, timeInPeriod: string, "
    "periodDescriptor: struct<number: int>, details: struct<eventOwnerTeamId: bigint, shootingPlayerId: bigint, "
    "goalieInNetId: bigint, shotType: string, xCoord: double, yCoord: double, zoneCode: string>>>, "
    "rosterSpots array<struct<teamId: bigint, playerId: bigint, firstName: struct<default: string>, lastName: struct<default: string>>>"
)
SCHEDULE = (
    "games array<struct<id: bigint, season: int, gameType: int, gameDate: string, startTimeUTC: string, "
    "homeTeam: struct<abbrev: string>, awayTeam: struct<abbrev: string>>>"
)
_OUTCOMES = "array<struct<name: string, description: string, point: double, price: double, multiplier: double>>"
_EVENT = (
    "struct<id: string, commence_time: string, home_team: string, away_team: string, "
    f"bookmakers: array<struct<key: string, markets: array<struct<key: string, outcomes: {_OUTCOMES}>>>>>"
)
ODDS_ENVELOPE = f"timestamp string, previous_timestamp string, next_timestamp string, data {_EVENT}"
BULK_ENVELOPE = f"timestamp string, previous_timestamp string, next_timestamp string, data array<{_EVENT}>"
# what the prices of an envelope's groups need: other fields are read past and not made into values
BULK_PRICES = (
    "data array<struct<bookmakers: array<struct<key: string, markets: array<struct<key: string, "
    "outcomes: array<struct<name: string, price: double>>>>>>>>"
)
HTTP_RECORD = "status_code int, fetched_at string, requested_ts string, pass_name string, event_id string, raw_body string"
INDEXED_PAYLOAD = (
    "players array<struct<id: string, first_name: string, last_name: string>>, "
    "appearances array<struct<id: string, player_id: string, match_id: bigint>>, "
    "games array<struct<id: bigint, home: string, away: string, scheduled_at: string>>, "
    "over_under_lines array<struct<id: string, appearance_id: string, stat: string, stat_value: double>>"
)
EVENTS_LIST = f"timestamp string, data array<struct<id: string, commence_time: string, home_team: string, away_team: string>>"

# fixed values: play types that are shots at goal
SHOT_TYPES = ("shot-on-goal", "goal", "missed-shot", "blocked-shot")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per document, with its file path in ``source_path``."""
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("source_path", F.col("_metadata.file_path"))


def parse_json(df: DataFrame, column: str, schema: str, keep: Sequence[str] = ()) -> DataFrame:
    """The same from a string column.

    The generator keeps later filters above the parse, which would otherwise be pushed down
    and parse every document once per filter.
    """
    return df.select(*keep, F.inline(F.array(F.from_json(F.col(column), schema))))


def _box_sides(keep_players: str) -> Column:
    def side(own: str, other: str, is_home: int) -> Column:
        return F.struct(
            F.lit(is_home).alias("is_home"),
            F.col(f"{own}.abbrev").alias("team_abbrev"),
            F.col(f"{other}.abbrev").alias("opponent_team"),
            F.col(f"{own}.score").alias("team_goals"),
            F.col(f"{own}.sog").alias("team_shots"),
            F.col(f"{other}.score").alias("opp_goals"),
            F.col(f"{other}.sog").alias("opp_shots"),
            F.col(f"playerByGameStats.{own}.{keep_players}").alias("players"),
        )

    return F.array(side("homeTeam", "awayTeam", 1), side("awayTeam", "homeTeam", 0))


def _goalie_rows(box: DataFrame) -> DataFrame:
    sides = box.select(F.col("id").alias("game_id"), F.to_date("gameDate").alias("game_date"), "season", F.inline(_box_sides("goalies")))
    return sides.select("*", F.explode("players").alias("g")).drop("players")


def goalie_games(box: DataFrame) -> DataFrame:
    """Starting goalies of both sides, one row per (game, starter)."""
    g = _goalie_rows(box).where(F.col("g.starter").isin("true", "1"))
    return g.select(
        "game_id", "game_date", "season", "team_abbrev", "opponent_team", "is_home",
        F.col("g.playerId").alias("goalie_id"), F.col("g.name.default").alias("goalie_name"),
        F.col("g.saves").alias("saves"), F.col("g.shotsAgainst").alias("shots_against"),
        F.col("g.goalsAgainst").alias("goals_against"), F.col("g.savePctg").alias("save_percentage"),
        F.col("g.toi").alias("toi"), "team_goals", "team_shots", "opp_goals", "opp_shots",
    )


def goalie_performance(box: DataFrame) -> DataFrame:
    """Every goalie who appears, with the 'saves/shots' strings split by situation."""
    out = _goalie_rows(box)
    cols = [F.col("g.playerId").alias("goalie_id"), F.coalesce(F.col("g.starter").isin("true", "1"), F.lit(False)).cast("int").alias("is_starter")]
    for source, name in (
        ("evenStrengthShotsAgainst", "even_strength"),
        ("powerPlayShotsAgainst", "power_play"),
        ("shorthandedShotsAgainst", "short_handed"),
    ):
        saves, shots = fraction_parts(F.col(f"g.{source}"))
        cols += [saves.alias(f"{name}_saves"), shots.alias(f"{name}_shots_against")]
    return out.select("game_id", "team_abbrev", *cols)


def team_game_sides(box: DataFrame) -> DataFrame:
    return box.select(F.col("id").alias("game_id"), F.inline(_box_sides("goalies"))).drop("players")


def skater_shots(box: DataFrame) -> DataFrame:
    def side(name: str, is_home: int) -> Column:
        players = F.concat(
            F.coalesce(F.col(f"playerByGameStats.{name}.forwards"), F.array()),
            F.coalesce(F.col(f"playerByGameStats.{name}.defense"), F.array()),
        )
        return F.struct(F.lit(is_home).alias("is_home"), F.col(f"{name}.abbrev").alias("team_abbrev"), players.alias("players"))

    sides = box.select(F.col("id").alias("game_id"), F.inline(F.array(side("homeTeam", 1), side("awayTeam", 0))))
    return sides.select("game_id", "is_home", "team_abbrev", F.explode("players").alias("p")).select(
        "game_id", "is_home", "team_abbrev", F.col("p.playerId").alias("player_id"), F.col("p.sog").alias("sog")
    )


def shot_events(pbp: DataFrame) -> DataFrame:
    """Shot plays with their position in the game's play list."""
    plays = pbp.select(F.col("id").alias("game_id"), F.posexplode("plays").alias("play_index", "p"))
    return plays.where(F.col("p.typeDescKey").isin(*SHOT_TYPES)).select(
        "game_id", "play_index", F.col("p.eventId").alias("event_id"), F.col("p.typeDescKey").alias("play_type"),
        F.col("p.periodDescriptor.number").alias("period"), F.col("p.timeInPeriod").alias("time_in_period"),
        F.col("p.details.shootingPlayerId").alias("shooter_id"), F.col("p.details.goalieInNetId").alias("goalie_id"),
        F.col("p.details.shotType").alias("shot_type"), F.col("p.details.xCoord").alias("x"), F.col("p.details.yCoord").alias("y"),
        (F.col("p.typeDescKey") == "goal").cast("int").alias("is_goal"),
    )


def rosters(pbp: DataFrame) -> DataFrame:
    """Distinct (season, team, player, name) from roster spots."""
    spots = pbp.select("season", F.col("homeTeam.id").alias("hid"), F.col("homeTeam.abbrev").alias("hab"),
                       F.col("awayTeam.id").alias("aid"), F.col("awayTeam.abbrev").alias("aab"), F.explode("rosterSpots").alias("r"))
    team = F.when(F.col("r.teamId") == F.col("hid"), F.col("hab")).when(F.col("r.teamId") == F.col("aid"), F.col("aab"))
    return spots.select(
        "season", team.alias("team_abbrev"), F.col("r.playerId").alias("player_id"),
        F.concat_ws(" ", "r.firstName.default", "r.lastName.default").alias("player_name"),
    ).where("team_abbrev is not null").distinct()


def schedule_rows(schedule: DataFrame, position: Sequence[str]) -> DataFrame:
    """Two team rows per game; the first document that lists a game wins."""

    def side(own: str, other: str, is_home: int) -> Column:
        return F.struct(
            F.col(f"g.{own}.abbrev").alias("team_abbrev"), F.col(f"g.{other}.abbrev").alias("opponent_team"), F.lit(is_home).alias("is_home")
        )

    games = schedule.select(*position, F.posexplode("games").alias("__pos", "g"))
    rows = games.select(*position, "__pos", "g", F.inline(F.array(side("homeTeam", "awayTeam", 1), side("awayTeam", "homeTeam", 0))))
    flat = rows.select(
        F.col("g.id").alias("game_id"), "team_abbrev",
        F.struct(
            "opponent_team", "is_home", F.col("g.season").alias("season"), F.col("g.gameType").alias("game_type"),
            F.to_date("g.gameDate").alias("game_date"), to_utc(F.col("g.startTimeUTC")).alias("start_time_utc"),
        ).alias("__v"),
        F.struct(*position, "__pos").alias("__at"),
    )
    return flat.groupBy("game_id", "team_abbrev").agg(F.min_by("__v", "__at").alias("__v")).select("game_id", "team_abbrev", "__v.*")


def _event_quotes(df: DataFrame, event: Column, keep: Sequence[str]) -> DataFrame:
    books = df.select(*keep, event.alias("e")).select(
        *keep, F.col("e.id").alias("event_id"), to_utc(F.col("e.commence_time")).alias("commence_time"),
        F.col("e.home_team").alias("home_team"), F.col("e.away_team").alias("away_team"), F.explode("e.bookmakers").alias("b"),
    )
    markets = books.select("*", F.col("b.key").alias("book"), F.explode("b.markets").alias("m")).drop("b")
    return markets.select("*", F.col("m.key").alias("market"), F.posexplode("m.outcomes").alias("outcome_index", "o")).drop("m")


def flatten_quotes(envelopes: DataFrame, markets: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per event, snapshot, book, market, player and side."""
    # time stamps are read before the envelope becomes many rows
    stamped = envelopes.select(*keep, to_utc(F.col("timestamp")).alias("resolved_ts"), "data")
    rows = _event_quotes(stamped, F.col("data"), [*keep, "resolved_ts"])
    return rows.where(F.col("market").isin(*markets)).select(
        *keep, "event_id", "commence_time", "home_team", "away_team", "resolved_ts",
        "book", "market", "outcome_index", F.col("o.description").alias("player_name_raw"), F.col("o.name").alias("side"),
        F.col("o.point").alias("line"), F.col("o.price").alias("price_decimal"),
    )


BULK_COLUMNS = ("event_id", "home_team", "resolved_ts", "book", "market", "outcome_label", "point", "price_decimal", "implied_prob_devig")


def flatten_bulk_markets(envelopes: DataFrame, markets: Sequence[str], keep: Sequence[str] = (), columns: Sequence[str] = BULK_COLUMNS) -> DataFrame:
    """The same for files that list every game of a slate, with each group's own de-vig.

    ``columns`` are those wanted; the envelopes need only the fields these are made of.
    """
    of_game = {"resolved_ts": to_utc(F.col("timestamp")), "event_id": F.col("d.id"), "home_team": F.col("d.home_team")}
    stamps = ["timestamp"] if "resolved_ts" in columns else []
    games = envelopes.select(*keep, *stamps, F.explode("data").alias("d"))
    rows = games.select(
        *keep, *[of_game[n].alias(n) for n in of_game if n in columns], F.explode("d.bookmakers").alias("b"),
    ).select("*", F.col("b.key").alias("book"), F.explode("b.markets").alias("m")).drop("b")
    # a group is clean when it has two outcomes and both are priced, so its total is a sum of two terms
    first, second = (F.get("m.outcomes", F.lit(i))["price"] for i in (0, 1))
    clean = (F.size("m.outcomes") == 2) & (first > 0) & (second > 0)
    total = 1.0 / first + 1.0 / second
    of_outcome = {
        "outcome_label": F.col("o.name"), "point": F.col("o.point"), "price_decimal": F.col("o.price"),
        "implied_prob_devig": 1.0 / F.nullif(F.col("o.price"), F.lit(0.0)) / F.col("__t"),
    }
    return (
        rows.where(F.col("m.key").isin(*markets))
        .select("*", F.col("m.key").alias("market"), F.when(clean, total).alias("__t"), F.explode("m.outcomes").alias("o"))
        .select(*keep, *[of_outcome[n].alias(n) if n in of_outcome else n for n in columns])
    )


def http_bodies(records: DataFrame, schema: str, keep: Sequence[str]) -> DataFrame:
    """Bodies of successful records, parsed; the JSON string inside the JSON record."""
    return parse_json(records.where("status_code = 200"), "raw_body", schema, keep)


def http_failures(records: DataFrame, by: Sequence[str]) -> DataFrame:
    return records.where("status_code is null or status_code <> 200").groupBy(*by, "status_code").agg(F.count(F.lit(1)).alias("n_records"))


def flatten_indexed_payload(payloads: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Lines with their player and game looked up by id inside the same payload.

    The side lists of one payload become maps, so no row leaves its document.
    """
    def as_map(column: str) -> Column:
        entries = F.transform(column, lambda x: F.struct(x["id"].alias("key"), x.alias("value")))
        return F.map_from_entries(entries)

    rows = payloads.select(
        *keep, as_map("players").alias("ps"), as_map("appearances").alias("aps"), as_map("games").alias("gs"),
        F.explode("over_under_lines").alias("l"),
    )
    a = F.try_element_at("aps", F.col("l.appearance_id"))
    found = rows.withColumn("a", a)
    p, g = F.try_element_at("ps", F.col("a.player_id")), F.try_element_at("gs", F.col("a.match_id"))
    return found.select(
        *keep, F.col("l.id").alias("line_id"), F.col("l.stat").alias("stat"), F.col("l.stat_value").alias("line"),
        F.concat_ws(" ", p["first_name"], p["last_name"]).alias("player_name"), g["home"].alias("home"), g["away"].alias("away"),
    )


# fixed values: the three archive file-name shapes
EVENTS_NAME = r"^events_date=(.+)\.json$"
ODDS_NAME = r"^odds_([0-9a-fA-F]{32})_date=(.+?)_markets=(.+?)_regions=(.+)\.json$"
BULK_NAME = r"^bulk_date=(.+?)_markets=(.+?)_regions=(.+)\.json$"


def parse_archive_names(files: DataFrame, name: str, keep: Sequence[str] = ()) -> DataFrame:
    """File inventory from names alone; a name of no known shape gets kind 'unparsable'."""
    n = F.col(name)
    is_events, is_odds, is_bulk = n.rlike(EVENTS_NAME), n.rlike(ODDS_NAME), n.rlike(BULK_NAME)

    def pick(odds_group: int, bulk_group: int) -> Column:
        return F.when(is_odds, F.regexp_extract(n, ODDS_NAME, odds_group)).when(is_bulk, F.regexp_extract(n, BULK_NAME, bulk_group))

    asked = F.when(is_events, F.regexp_extract(n, EVENTS_NAME, 1)).otherwise(pick(2, 1))
    kind = F.when(is_events, F.lit("events")).when(is_odds, F.lit("odds")).when(is_bulk, F.lit("bulk")).otherwise(F.lit("unparsable"))
    return files.select(
        *keep, kind.alias("kind"), F.when(is_odds, F.regexp_extract(n, ODDS_NAME, 1)).alias("event_id"),
        canonical_list(pick(3, 2)).alias("markets"), canonical_list(pick(4, 3)).alias("regions"),
        to_utc(F.translate(asked, "_", ":")).alias("requested_ts"),
    )


def scan_archive(spark: SparkSession, path: str) -> DataFrame:
    """Manifest of an archive folder, a row per file: what its name says, its envelope's time stamps, and a status.

    Files are listed without their contents; of the contents only the envelope is parsed. A file that is broken, of
    an unknown name or without a time stamp is a row that says so (first reason in that order), not a missing one. Files of no bytes are passed over, as by all of Spark's readers.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"), F.col("length").alias("n_bytes"))
    envelope = "timestamp string, previous_timestamp string, next_timestamp string, __broken string"
    heads = spark.read.schema(envelope).option("columnNameOfCorruptRecord", "__broken").json(path, multiLine=True)
    stamps = {"resolved_ts": "timestamp", "previous_ts": "previous_timestamp", "next_ts": "next_timestamp"}
    read = heads.select(F.col("_metadata.file_path").alias("path"), F.col("__broken").isNotNull().alias("__bad"), *[to_utc(F.col(c)).alias(n) for n, c in stamps.items()])
    # a file is one envelope; were it several, the newest counts
    once = read.groupBy("path").agg(F.max("__bad").alias("__bad"), *[F.max_by(n, "resolved_ts").alias(n) for n in stamps])
    rows = files.join(once, "path", "left")
    named = parse_archive_names(rows, "file_name", ["path", "file_name", "n_bytes", "__bad", *stamps])
    status = (
        F.when(F.col("__bad"), F.lit("broken"))
        .when((F.col("kind") == "unparsable") | F.col("requested_ts").isNull(), F.lit("bad name")).when(F.col("resolved_ts").isNull(), F.lit("no time stamp"))
        .otherwise(F.lit("ok"))
    )
    return named.withColumn("status", status).drop("__bad")


def event_dimension(lists: DataFrame, position: Sequence[str]) -> DataFrame:
    """One row per event id; the last file that lists it wins."""
    rows = lists.select(*position, F.explode("data").alias("e"))
    return rows.groupBy(F.col("e.id").alias("event_id")).agg(
        F.max_by(F.struct("e.commence_time", "e.home_team", "e.away_team"), F.struct(*position)).alias("v")
    ).select("event_id", "v.*")


def melt_home_away(df: DataFrame, keep: Sequence[str], values: dict[str, tuple[str, str]]) -> DataFrame:
    """Home and away columns to two rows per game."""

    def side(index: int, is_home: int) -> Column:
        return F.struct(F.lit(is_home).alias("is_home"), *[F.col(pair[index]).alias(n) for n, pair in values.items()])

    return df.select(*keep, F.inline(F.array(side(0, 1), side(1, 0))))


def explode_legs(df: DataFrame, legs: str, keep: Sequence[str], max_legs: int = 3) -> DataFrame:
    """NAME:TEAM:SIDE:LINE[:ODDS[:BOOK]] strings to leg rows with a problem column."""
    pieces = F.filter(F.transform(F.split(F.col(legs), ";"), lambda x: F.trim(x)), lambda x: x != "")
    rows = df.select(*keep, F.size(pieces).alias("__n"), F.posexplode(pieces).alias("__i", "__raw"))
    f = F.split("__raw", ":")

    def part(i: int) -> Column:
        return F.trim(F.get(f, F.lit(i)))

    side, line = F.upper(part(2)), part(3).try_cast("double")
    odds_text = F.nullif(F.coalesce(part(4), F.lit("")), F.lit(""))
    odds = odds_text.try_cast("int")
    problem = (
        F.when(~F.size(f).between(4, 6), F.lit("bad field count"))
        .when(~F.coalesce(side.isin("OVER", "UNDER"), F.lit(False)), F.lit("bad side"))
        .when(line.isNull(), F.lit("bad line"))
        .when(odds_text.isNotNull() & odds.isNull(), F.lit("bad odds"))
        .when(F.col("__n") > max_legs, F.lit("too many legs"))
        .otherwise(F.lit(""))
    )
    return rows.select(
        *keep, (F.col("__i") + 1).alias("leg_number"), part(0).alias("goalie_name"),
        F.nullif(F.upper(part(1)), F.lit("")).alias("team_abbrev"), side.alias("side"), line.alias("line_at_bet"),
        odds.alias("odds_at_bet"), F.nullif(F.coalesce(part(5), F.lit("")), F.lit("")).alias("book"), problem.alias("problem"),
    )
