"""Temporal, tolerant and contract-checked joins.

Each range-type join has an equi key, so it runs as a hash or sort-merge join with a
residual predicate.  Heavy keys on the many side are split by adaptive skew joins;
as-of joins use one running pass instead of pairing rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formbook.functions.text import last_name, pair_key, person_initial, person_last, person_name, plain_name
from formbook.operators.quality import GateFailed, duplicate_keys, require_unique
from formbook.operators.skew import DEFAULT_RULE, Running, SplitRule, bounded_frame, hot_keys, join_back, running, with_group_totals


def enrich(
    left: DataFrame, right: DataFrame, on: Sequence[str], prefix: str = "", matched: str = "matched", check: bool = False
) -> DataFrame:
    """Many-to-one left join that keeps every left row exactly once.

    Right columns get ``prefix``; a name clash is an error.  A key that is repeated on the
    right never multiplies rows: it stops the query, by a count per key in the shuffle that the join needs anyway.
    ``check=True`` finds it before the query runs, with example keys.
    """
    values = [c for c in right.columns if c not in on]
    clash = sorted({prefix + c for c in values} & set(left.columns))
    if clash:
        raise GateFailed(f"column collision on {clash}")
    if check:
        require_unique(right, on)
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in on])  # a NULL key matches nothing
    facts = F.struct(*[F.col(c).alias(prefix + c) for c in values], F.lit(1).alias(matched))
    per_key = right.where(whole).groupBy(*on).agg(F.any_value(facts).alias("__f"), F.count(F.lit(1)).alias("__n"))
    repeated = F.raise_error(F.concat(F.lit("repeated key in many-to-one join: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in on])))
    once = per_key.where(F.when(F.col("__n") == 1, F.lit(True)).otherwise(repeated.cast("boolean"))).select(*on, "__f.*")
    return join_back(left, once, on, "left").withColumn(matched, F.coalesce(matched, F.lit(0)))


def choose_join_key(left: DataFrame, right: DataFrame, candidates: Sequence[Sequence[str]]) -> list[str]:
    """First candidate key present on both sides and unique on the right."""
    for key in candidates:
        present = all(k in left.columns and k in right.columns for k in key)
        if present and not duplicate_keys(right, key).limit(1).count():
            return list(key)
    raise GateFailed(f"no unique join key among {list(candidates)}")


def both_sides(
    games: DataFrame, ratings: DataFrame, game_keys: Sequence[str], team: str, own: str, opponent: str, values: Sequence[str]
) -> DataFrame:
    """Join a rating table twice: as the row's own team and as its opponent."""

    def side(prefix: str, column: str) -> DataFrame:
        return ratings.select(
            *game_keys, F.col(team).alias(column), *[F.col(v).alias(f"{prefix}_{v}") for v in values]
        )

    with_own = join_back(games, side("own", own), [*game_keys, own], "left")
    return join_back(with_own, side("opp", opponent), [*game_keys, opponent], "left")


def opponent_row(df: DataFrame, game: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The other row's values where a game has exactly two rows; NULL elsewhere.

    Game totals less the row's own value, so no pairs are formed.
    """
    totals = {"__n": F.count(F.lit(1))}
    for v in values:
        totals |= {f"__s_{v}": F.sum(v), f"__c_{v}": F.count(v)}
    joined = with_group_totals(df, game, totals)
    out = {}
    for v in values:
        other = F.col(f"__s_{v}") - F.coalesce(F.col(v), F.lit(0))
        seen = F.col(f"__c_{v}") - F.when(F.col(v).isNotNull(), 1).otherwise(0)
        out[f"opp_{v}"] = F.when((F.col("__n") == 2) & (seen == 1), other)
    return joined.withColumns(out).drop("__n", *[f"__s_{v}" for v in values], *[f"__c_{v}" for v in values])


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_ts: str,
    right_ts: str,
    right_order: Sequence[str],
    values: Sequence[str],
    left_id: Sequence[str],
    fallback: bool = False,
    rule: SplitRule = DEFAULT_RULE,
) -> DataFrame:
    """Latest right row at or before each left time, per key.

    Both sides are stacked and the last right row is carried forward, so the work is one
    sort per key whatever the match counts are.  ``right_order`` breaks equal times (the
    largest wins).  With ``fallback`` a left row that precedes every right row takes the
    key's latest one.
    """
    payload = F.struct(*[F.col(v) for v in values])
    empty = F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType)
    ordering = right.select(F.struct(*[F.col(c) for c in right_order]).alias("o")).schema["o"].dataType
    rows_r = right.select(
        *by, F.col(right_ts).alias("__ts"), F.lit(0).alias("__side"), F.struct(*right_order).alias("__o"), payload.alias("__p"),
        F.lit(None).cast(left.select(F.struct("*").alias("l")).schema["l"].dataType).alias("__l"),
    )
    rows_l = left.select(
        *by, F.col(left_ts).alias("__ts"), F.lit(1).alias("__side"), F.lit(None).cast(ordering).alias("__o"), empty.alias("__p"),
        F.struct("*").alias("__l"),
    )
    order = [F.col("__ts"), F.col("__side"), F.col("__o"), *[F.col(f"__l.{c}") for c in left_id]]
    carried = running(rows_r.unionByName(rows_l), by, order, {"__last": Running("last", F.col("__p"))}, rule=rule)
    hits = carried.where(F.col("__side") == 1)
    if fallback:
        latest = right.groupBy(*by).agg(F.max_by(payload, F.struct(right_ts, *right_order)).alias("__latest"))
        hits = join_back(hits, latest, by, "left", rule).withColumn("__last", F.coalesce("__last", "__latest"))
    return hits.select("__l.*", *[F.col(f"__last.{v}").alias(f"asof_{v}") for v in values])


def closing_snapshot(
    df: DataFrame, key: Sequence[str], ts: str, tie: str, start: str, values: Sequence[str]
) -> DataFrame:
    """Last snapshot at or before the start, where the start is the first one recorded.

    With no start, or nothing before it, the last snapshot of the key is used.
    """
    first_start = F.min_by(start, F.when(F.col(start).isNotNull(), F.struct(ts, tie)))
    ok = F.coalesce(F.col(ts) <= F.col("scheduled_start"), F.lit(False))
    best = F.max_by(F.struct(tie, ts, *values), F.struct(ok, ts, tie))
    return (
        with_group_totals(df, key, {"scheduled_start": first_start})
        .groupBy(*key, "scheduled_start")
        .agg(best.alias("__b"), F.max(ok.cast("int")).alias("had_pregame"))
        .select(
            *key,
            "scheduled_start",
            F.col(f"__b.{tie}").alias("closing_id"),
            F.col(f"__b.{ts}").alias("closing_ts"),
            *[F.col(f"__b.{v}").alias(f"closing_{v}") for v in values],
            "had_pregame",
        )
    )


def latest_pregame(df: DataFrame, event: Sequence[str], ts: str, start: str, facts: Sequence[str]) -> DataFrame:
    """Flag each event's newest snapshot at or before its start, with the freshest facts."""
    heavy = hot_keys(df, event)
    fresh = F.max_by(F.struct(start, *facts), F.struct(ts, start, *facts))
    joined = with_group_totals(df, event, {"__f": fresh}, heavy=heavy).select(
        *df.columns, F.col(f"__f.{start}").alias("canonical_start"), *[F.col(f"__f.{c}").alias(f"canonical_{c}") for c in facts]
    )
    last = F.max(F.when(F.col(ts) <= F.col("canonical_start"), F.col(ts)))
    flag = F.coalesce(F.col(ts) == F.col("__last"), F.lit(False)).cast("int")
    return with_group_totals(joined, event, {"__last": last}, heavy=heavy).withColumn("is_latest_pregame", flag).drop("__last")


def asof_anchor(df: DataFrame, game: Sequence[str], ts: str, anchor: str) -> DataFrame:
    """Rows at each game's newest time not after its anchor, with the dropped counts."""
    stats = {"asof_ts": F.max(F.when(F.col(ts) <= F.col(anchor), F.col(ts))), "n_after_anchor": F.count_if(F.col(ts) > F.col(anchor))}
    return with_group_totals(df, game, stats).where(F.col(ts) == F.col("asof_ts"))


def tolerant_date_join(
    left: DataFrame,
    right: DataFrame,
    entity: Sequence[str],
    date: str,
    values: Sequence[str],
    left_id: Sequence[str],
    offsets: Sequence[int] = (0, -1, 1),
) -> DataFrame:
    """Match on entity and a date within the offsets, earlier offsets first.

    The left rows carry one candidate per offset, so this is an equi-join; the best hit
    per left row is a decomposable minimum.  Of several right rows on one day the least
    values win, so input order does not matter.
    """
    tries = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(o).alias("offset")) for i, o in enumerate(offsets)])
    asked = left.select("*", F.explode(tries).alias("__t")).withColumn(
        "__d", F.date_add(F.to_date(date), F.col("__t.offset"))
    )
    facts = right.select(*entity, F.to_date(date).alias("__d"), *[F.col(v).alias(f"__r_{v}") for v in values], F.lit(1).alias("__hit"))
    found = join_back(asked, facts, [*entity, "__d"])
    best = found.groupBy(*left_id).agg(
        F.min_by(
            F.struct(F.col("__t.offset").alias("offset"), *[F.col(f"__r_{v}").alias(v) for v in values]),
            F.struct(F.col("__t.rank"), *[F.col(f"__r_{v}") for v in values]),
        ).alias("__b")
    )
    return left.join(best, list(left_id), "left").select(
        left["*"], F.col("__b.offset").alias("day_offset"), *[F.col(f"__b.{v}").alias(f"matched_{v}") for v in values]
    )


def match_entities(
    asks: DataFrame,
    roster: DataFrame,
    ask_id: Sequence[str],
    date: str,
    home: str,
    away: str,
    name: str,
    roster_team: str,
    roster_opponent: str,
    roster_name: str,
    roster_id: str,
    offsets: Sequence[int] = (0, -1, 1),
) -> DataFrame:
    """Resolve a quoted name to a roster row: home team before away, then day offsets.

    The opponent and the accent-free last name must agree.  An unmatched ask gets the
    reason that came closest: no roster row, wrong opponent, or another name.  Resolution
    runs on distinct asks and joins back, as one ask recurs across books and sides.  Equal
    ranks go to the least roster id.
    """
    tries = [(s, i, o) for s in (0, 1) for i, o in enumerate(offsets)]
    options = F.array(
        *[F.struct(F.lit(s * len(offsets) + i).alias("rank"), F.lit(s).alias("side"), F.lit(o).alias("offset")) for s, i, o in tries]
    )
    distinct = asks.select(*ask_id, date, home, away, name).distinct()
    asked = distinct.select("*", F.explode(options).alias("__t")).select(
        *ask_id,
        F.col("__t.rank").alias("__rank"),
        plain_name(last_name(F.col(name))).alias("__want"),
        F.when(F.col("__t.side") == 0, F.col(home)).otherwise(F.col(away)).alias("__team"),
        F.when(F.col("__t.side") == 0, F.col(away)).otherwise(F.col(home)).alias("__versus"),
        F.date_add(F.to_date(date), F.col("__t.offset")).alias("__d"),
    )
    facts = roster.select(
        F.to_date(date).alias("__d"),
        F.col(roster_team).alias("__team"),
        F.col(roster_opponent).alias("__r_versus"),
        F.col(roster_id).alias("__r_id"),
        F.col(roster_name).alias("__r_name"),
        plain_name(last_name(F.col(roster_name))).alias("__have"),
    )
    joined = join_back(asked, facts, ["__d", "__team"], "left")
    same_versus = F.coalesce(F.col("__r_versus") == F.col("__versus"), F.lit(False))
    same_name = F.coalesce((F.col("__have") == F.col("__want")) & (F.col("__want") != ""), F.lit(False))
    hit = same_versus & same_name
    verdict = joined.groupBy(*ask_id).agg(
        F.min_by(F.struct("__r_id", "__r_name"), F.when(hit, F.struct("__rank", "__r_id", "__r_name"))).alias("__m"),
        F.max(hit.cast("int")).alias("__hit"),
        F.max(same_versus.cast("int")).alias("__versus_seen"),
        F.max(F.col("__r_id").isNotNull().cast("int")).alias("__row_seen"),
    )
    status = (
        F.when(F.col("__hit") == 1, F.lit("matched"))
        .when(F.col("__versus_seen") == 1, F.lit("name_mismatch"))
        .when(F.col("__row_seen") == 1, F.lit("opponent_mismatch"))
        .otherwise(F.lit("no_game"))
    )
    return verdict.select(
        *ask_id, status.alias("match_status"), F.col("__m.__r_id").alias("matched_id"), F.col("__m.__r_name").alias("matched_name")
    )


def attribute_names(asks: DataFrame, roster: DataFrame, scope: Sequence[str], name: str, roster_name: str, team: str) -> DataFrame:
    """Team of a name: full name first, then initial plus last name; more than one team is ambiguous."""
    full = roster.groupBy(*scope, person_name(F.col(roster_name)).alias("__full")).agg(
        F.count_distinct(team).alias("__n_full"), F.min(team).alias("__t_full")
    )
    short = roster.groupBy(
        *scope, person_initial(F.col(roster_name)).alias("__init"), person_last(F.col(roster_name)).alias("__last")
    ).agg(F.count_distinct(team).alias("__n_short"), F.min(team).alias("__t_short"))
    keyed = asks.withColumns(
        {"__full": person_name(F.col(name)), "__init": person_initial(F.col(name)), "__last": person_last(F.col(name))}
    )
    joined = join_back(join_back(keyed, full, [*scope, "__full"], "left"), short, [*scope, "__init", "__last"], "left")
    n = F.coalesce("__n_full", "__n_short", F.lit(0))
    status = F.when(n == 0, F.lit("unresolved")).when(n == 1, F.lit("resolved")).otherwise(F.lit("ambiguous"))
    return joined.select(
        *asks.columns, status.alias("attribution"), F.when(n == 1, F.coalesce("__t_full", "__t_short")).alias("attributed_team")
    )


def map_events_to_games(
    events: DataFrame, games: DataFrame, date: str, home: str, away: str, game_id: str, event_id: str
) -> DataFrame:
    """Event to game by date and unordered team pair, flagging pairs with several games."""
    key = ["__d", "__pair"]
    g = (
        games.withColumns({"__d": F.to_date(date), "__pair": pair_key(F.col(home), F.col(away))})
        .groupBy(*key)
        .agg(F.count_distinct(game_id).alias("__n"), F.min(game_id).alias("game_id_matched"))
    )
    e = events.withColumns({"__d": F.to_date(date), "__pair": pair_key(F.col(home), F.col(away))})
    n = F.coalesce("__n", F.lit(0))
    status = F.when(n == 0, F.lit("unmatched")).when(n == 1, F.lit("matched")).otherwise(F.lit("ambiguous"))
    return join_back(e, g, key, "left").select(
        event_id, status.alias("map_status"), F.when(n == 1, F.col("game_id_matched")).alias("game_id_matched")
    )


def replacement_candidates(
    asks: DataFrame, events: DataFrame, pair: Sequence[str], date: str, ask_id: str, radius_days: int = 30
) -> DataFrame:
    """How many events of the same pair lie within the radius of each ask, and how near the nearest is.

    Everything happens on one row per (pair, day): a range window counts the events around
    each day and two running windows find the nearest event day on either side, so no ask
    is paired with its candidates.
    """
    day = F.to_date(F.col(date))
    held = events.groupBy(*pair, day.alias("__d")).agg(F.count(F.lit(1)).alias("__n"))
    asked = asks.select(*pair, day.alias("__d")).distinct().withColumn("__n", F.lit(0).cast("long"))
    days = held.unionByName(asked).groupBy(*pair, "__d").agg(F.sum("__n").alias("__n"))
    line = Window.partitionBy(*pair).orderBy(F.unix_date("__d"))  # bounded by the calendar
    has = F.when(F.col("__n") > 0, F.col("__d"))
    before = F.last(has, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(has, ignorenulls=True).over(line.rowsBetween(0, Window.unboundedFollowing))
    gap = F.least(F.datediff("__d", before), F.datediff(after, "__d"))
    facts = days.select(
        *pair, "__d", F.sum("__n").over(line.rangeBetween(-radius_days, radius_days)).alias("n_candidates"),
        F.when(gap <= radius_days, gap).alias("nearest_gap_days"),
    )
    return join_back(asks.withColumn("__d", day), facts, [*pair, "__d"], "left").select(ask_id, "n_candidates", "nearest_gap_days")


def covered_requests(
    requests: DataFrame,
    manifest: DataFrame,
    key: Sequence[str],
    requested: str,
    resolved: str,
    next_ts: str,
    manifest_requested: str,
    request_id: Sequence[str],
    rule: SplitRule = DEFAULT_RULE,
) -> DataFrame:
    """Flag requests inside any held [resolved, next) interval, or asked for exactly before.

    Intervals per key may overlap, so the newest interval alone does not decide: the
    furthest end among intervals already begun does.  That is a running maximum over the
    merged time line, linear in rows instead of one comparison per pair.
    """
    open_end = F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")
    spans = manifest.where(F.col(resolved).isNotNull()).select(
        *key, F.col(resolved).cast("timestamp_ntz").alias("__ts"), F.lit(0).alias("__side"),
        F.coalesce(F.col(next_ts).cast("timestamp_ntz"), open_end).alias("__end"),
        F.lit(None).cast(requests.select(F.struct(*request_id).alias("i")).schema["i"].dataType).alias("__id"),
    )
    asks = requests.select(
        *key, F.col(requested).cast("timestamp_ntz").alias("__ts"), F.lit(1).alias("__side"),
        F.lit(None).cast("timestamp_ntz").alias("__end"), F.struct(*request_id).alias("__id"),
    )
    order = [F.col("__ts"), F.col("__side"), F.col("__end"), F.col("__id")]
    swept = running(spans.unionByName(asks), key, order, {"__reach": Running("max", F.col("__end"))}, rule=rule)
    inside = swept.where("__side = 1").select(
        "__id.*", F.coalesce(F.col("__ts") < F.col("__reach"), F.lit(False)).alias("__inside")
    )
    exact = manifest.select(*key, F.col(manifest_requested).alias(requested), F.lit(True).alias("__exact")).distinct()
    return (
        join_back(requests.join(inside, list(request_id)), exact, [*key, requested], "left", rule)
        .withColumn("is_covered", (F.col("__inside") | F.coalesce("__exact", F.lit(False))).cast("int"))
        .drop("__inside", "__exact")
    )


def anchor_gaps(events: DataFrame, snapshots: DataFrame, event: str, anchor: str, ts: str, tolerance_seconds: float) -> DataFrame:
    """Smallest distance of any snapshot to each event's anchor, and whether none is close."""
    gap = F.abs(F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col(anchor).cast("timestamp"))) / 1e6
    best = join_back(snapshots.select(event, ts), events.select(event, anchor), [event]).groupBy(event).agg(F.min(gap).alias("min_gap_seconds"))
    near = F.coalesce(F.col("min_gap_seconds") <= tolerance_seconds, F.lit(False))
    return events.join(best, event, "left").withColumn("needs_purchase", (~near).cast("int"))


def key_coverage(left: DataFrame, right: DataFrame, on: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Share of distinct left keys that exist on the right, overall per ``by`` group."""
    marks = right.select(*on).distinct().withColumn("__hit", F.lit(1))
    keys = join_back(left.select(*by, *[c for c in on if c not in by]).distinct(), marks, on, "left")
    return keys.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_keys"), F.count("__hit").alias("n_matched"), F.avg(F.coalesce("__hit", F.lit(0)).cast("double")).alias("match_rate")
    )


def shifted_season_join(df: DataFrame, history: DataFrame, team: str, season: str, value: str, name: str, aliases: dict[str, str]) -> DataFrame:
    """Prior-season mean of a team, following relocated franchises."""

    def franchise(c: str) -> Column:
        return reduce(lambda acc, kv: F.when(F.col(c) == kv[0], F.lit(kv[1])).otherwise(acc), aliases.items(), F.col(c))

    means = history.groupBy((F.col(season) + 1).alias(season), franchise(team).alias("__fr")).agg(F.avg(value).alias(name))
    return join_back(df.withColumn("__fr", franchise(team)), means, [season, "__fr"], "left").drop("__fr")


def supplement(first: DataFrame, second: DataFrame, date: str) -> DataFrame:
    """All of the first source, and the second only after the first one ends."""
    late = second.where(F.col(date) > first.agg(F.max(date)).scalar())
    return first.unionByName(late, allowMissingColumns=True)


def next_row(
    df: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str], rule: SplitRule = DEFAULT_RULE
) -> DataFrame:
    """The following row's values within a key."""
    return bounded_frame(
        df, by, [F.col(o) for o in order], lambda w: {f"next_{v}": F.lead(v).over(w) for v in values}, ahead=1, rule=rule
    )


def season_of(df: DataFrame, season_dates: DataFrame, date: str) -> DataFrame:
    """Label rows by an inclusive date range from a declared dimension of disjoint ranges."""
    w = Window.orderBy("start_date")
    overlap = season_dates.withColumn("__prev", F.lag("end_date").over(w)).where(F.col("__prev") >= F.col("start_date"))
    if overlap.limit(1).count():
        raise GateFailed("season ranges overlap")
    ranges = season_dates.agg(F.collect_list(F.struct("season", "start_date", "end_date"))).scalar()
    day = F.to_date(date)
    hit = F.filter("__ranges", lambda r: (day >= r["start_date"]) & (day <= r["end_date"]))
    label = F.coalesce(F.try_element_at(hit, F.lit(1))["season"], F.lit("other"))
    return df.withColumn("__ranges", ranges).withColumn("season", label).drop("__ranges")
