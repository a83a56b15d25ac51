"""Names, timestamps and small string formats (Column in, Column out)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_map() -> tuple[str, str]:
    """Every Latin letter whose compatibility decomposition is one base letter plus marks."""
    src, dst = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        char = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if len(base) == 1 and base != char:
            src.append(char)
            dst.append(base)
    return "".join(src), "".join(dst)


ACCENTED, PLAIN = _accent_map()

ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def strip_accents(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"\p{Mn}+", "")


def plain_name(name: Column) -> Column:
    """Accent-free lower-case name; missing becomes the empty string."""
    return F.coalesce(F.lower(F.trim(strip_accents(name))), F.lit(""))


def last_name(name: Column) -> Column:
    parts = F.split(F.trim(name), r"\s+")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -1)).otherwise(name)


def person_name(name: Column) -> Column:
    """Name without parenthesised notes, apostrophes, punctuation and suffixes."""
    head = F.regexp_replace(F.trim(F.element_at(F.split(name, r"\("), 1)), "['’]", "")
    # letters that have no plain form vanish instead of splitting the word
    ascii_only = F.regexp_replace(strip_accents(head), r"[^\x00-\x7F]", "")
    words = F.split(F.regexp_replace(F.lower(ascii_only), "[^a-z0-9]+", " "), " ")
    # fixed values: generational suffixes that are not part of a name
    keep = F.filter(words, lambda w: (w != "") & ~w.isin("jr", "sr", "ii", "iii", "iv"))
    return F.array_join(keep, " ")


def person_initial(name: Column) -> Column:
    return F.substring(person_name(name), 1, 1)


def person_last(name: Column) -> Column:
    return F.element_at(F.split(person_name(name), " "), -1)


def identity_key(entity_id: Column, name: Column) -> Column:
    return F.coalesce(F.concat(F.lit("gid:"), entity_id.cast("string")), F.concat(F.lit("name:"), F.lower(F.trim(name))))


def to_utc(text: Column) -> Column:
    """ISO text with Z, an offset or nothing to a timestamp; NULL when it is not one."""
    clean = F.trim(text)
    return F.when(clean.rlike(ISO_SHAPE), F.try_to_timestamp(clean))


def utc_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def eastern_date(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, "America/New_York"))


def bettime_anchor(commence: Column) -> Column:
    """The earlier of 22:30 UTC on the Eastern date and half an hour before the start."""
    evening = F.to_timestamp(eastern_date(commence)) + F.expr("INTERVAL '22:30' HOUR TO MINUTE")
    return F.least(evening, commence - F.expr("INTERVAL '30' MINUTE"))


def snapshot_pass(requested: Column, commence: Column, cutoff_minutes: int = 5) -> Column:
    bound = commence - F.expr(f"INTERVAL '{cutoff_minutes}' MINUTE")
    return F.when(requested >= bound, F.lit("closing")).when(requested < bound, F.lit("bettime"))


def clock_minutes(clock: Column) -> Column:
    """'MM:SS' to minutes; NULL when either part is not a number."""
    parts = F.split(clock, ":")
    minutes, seconds = parts.getItem(0).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    return F.when(F.size(parts) == 2, minutes + seconds / 60.0)


def fraction_parts(text: Column) -> tuple[Column, Column]:
    """'saves/shots' to two integers; malformed text gives (0, 0)."""
    parts = F.split(text, "/")
    made, tried = parts.getItem(0).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")
    good = (F.size(parts) == 2) & made.isNotNull() & tried.isNotNull()
    return F.when(good, made).otherwise(F.lit(0)), F.when(good, tried).otherwise(F.lit(0))


def canonical_list(text: Column) -> Column:
    """Comma list with blanks dropped and members sorted, so order does not matter."""
    members = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.array_sort(members), ",")


def pair_key(a: Column, b: Column) -> Column:
    """Unordered pair as one join key."""
    return F.array_join(F.array_sort(F.array(a, b)), "|")


def map_code(value: Column, codes: dict[str, str]) -> Column:
    """Look a value up in a small fixed table held as a map literal."""
    flat = [F.lit(x) for pair in codes.items() for x in pair]
    return F.try_element_at(F.create_map(*flat), value)


def row_checksum(*columns: str) -> Column:
    """SHA-256 of the named columns as JSON in sorted column order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def season_label(date: Column, bounds: list[tuple[str, str, str]]) -> Column:
    out = F.when(date.isNull(), F.lit(None).cast("string"))
    for label, start, end in bounds:
        out = out.when(date.between(F.lit(start).cast("date"), F.lit(end).cast("date")), F.lit(label))
    return out.otherwise(F.lit("other"))


# fixed values: full team name to three-letter code
TEAM_CODES = {
    "Anaheim Ducks": "ANA", "Arizona Coyotes": "ARI", "Boston Bruins": "BOS", "Buffalo Sabres": "BUF", "Calgary Flames": "CGY",
    "Carolina Hurricanes": "CAR", "Chicago Blackhawks": "CHI", "Colorado Avalanche": "COL",
    "Columbus Blue Jackets": "CBJ", "Dallas Stars": "DAL", "Detroit Red Wings": "DET",
    "Edmonton Oilers": "EDM", "Florida Panthers": "FLA", "Los Angeles Kings": "LAK", "Minnesota Wild": "MIN",
    "Montreal Canadiens": "MTL", "Montréal Canadiens": "MTL", "Nashville Predators": "NSH",
    "New Jersey Devils": "NJD", "New York Islanders": "NYI", "New York Rangers": "NYR",
    "Ottawa Senators": "OTT", "Philadelphia Flyers": "PHI", "Pittsburgh Penguins": "PIT",
    "San Jose Sharks": "SJS", "Seattle Kraken": "SEA", "St Louis Blues": "STL", "St. Louis Blues": "STL",
    "Tampa Bay Lightning": "TBL", "Toronto Maple Leafs": "TOR", "Utah Hockey Club": "UTA",
    "Utah Mammoth": "UTA", "Vancouver Canucks": "VAN", "Vegas Golden Knights": "VGK",
    "Washington Capitals": "WSH", "Winnipeg Jets": "WPG",
}

# fixed values: a relocated franchise keeps its predecessor's history
FRANCHISE_ALIASES = {"UTA": "ARI"}

# fixed values: season label, first and last Eastern game date
SEASON_BOUNDS = [
    ("2023-24", "2023-08-01", "2024-07-31"),
    ("2024-25", "2024-08-01", "2025-07-31"),
    ("2025-26", "2025-08-01", "2026-07-31"),
]
