"""Column functions of names, dates, labels and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHANNEL = "VB at Night"
#: Words and tones of outcomes, grades that cost or earn a point, and the family of a touch.
OUTCOMES = {
    "kill": "good", "ace": "good", "block": "good", "attack_error": "bad", "service_error": "bad", "other_error": "bad",
}
FAMILY = {"receive": "defense", "dig": "defense"}


def norm_name(name: Column) -> Column:
    """Lower-cased, trimmed, without a trailing count, blanks squeezed, in that order."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(F.coalesce(name, F.lit("")))), r"\s+\d+$", ""), r"\s+", " ")


def near_name(a: Column, b: Column) -> Column:
    """Edit distance of at most one, for names whose lengths differ by one at most."""
    return (F.abs(F.length(a) - F.length(b)) <= 1) & (F.levenshtein(a, b) <= 1)


def public_name(name: Column) -> Column:
    """First word; null for a blank name."""
    first = F.element_at(F.split(F.trim(name), r"\s+"), 1)
    return F.when(first != "", first)


def is_placeholder(name: Column) -> Column:
    return name.rlike(r"^P\d+$")


def player_slug(name: Column, player_id: Column) -> Column:
    """Accent-folded first name and id, or the id alone; accents of Latin letters are folded by a fixed map."""
    accented, plain = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
    first = F.regexp_replace(F.translate(F.lower(F.coalesce(public_name(name), F.lit(""))), accented, plain), "[^a-z0-9]+", "")
    number = player_id.cast("string")
    return F.when(first != "", F.concat_ws("-", first, number)).otherwise(number)


def parse_player_slug(slug: Column) -> Column:
    """The digits at the end, alone or after a dash; else null."""
    found = F.regexp_extract(F.trim(slug), r"^(?:.*-)?(\d+)$", 1)
    return F.when(found != "", found.cast("long"))


def public_caption(caption: Column) -> Column:
    """What follows a dash between blanks is cut to its first word."""
    return F.regexp_replace(caption, r"^(.*?\s[-–—]\s)\s*(\S+).*$", "$1$2")


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"\.[^.]*$", "")


def day_label(day: Column) -> Column:
    """Tue, Jul 21 2026."""
    return F.date_format(day, "EEE, MMM d yyyy")


def game_number(slot: Column) -> Column:
    return F.when(slot > 0, F.concat(F.lit("Game "), slot.cast("string")))


def _legacy(name: Column, game_id: Column) -> Column:
    blank = F.trim(F.coalesce(name, F.lit("")))
    return F.when(blank != "", blank).otherwise(F.concat(F.lit("Game #"), game_id.cast("string")))


def _override(label: Column) -> Column:
    cut = F.trim(label)
    return F.when(cut != "", cut)


def display_name(label: Column, day: Column, slot: Column, name: Column, game_id: Column) -> Column:
    return F.coalesce(_override(label), F.when(day.isNull(), _legacy(name, game_id)).otherwise(F.concat_ws(" · ", day_label(day), game_number(slot))))


def channel_title(label: Column, day: Column, slot: Column, name: Column, game_id: Column) -> Column:
    """Title for a channel, with ISO dates, of 100 characters at most."""
    iso = F.date_format(day, "yyyy-MM-dd")
    core = F.when(_override(label).isNotNull(), F.concat_ws(" · ", iso, _override(label))).when(day.isNotNull(), F.concat_ws(" · ", iso, game_number(slot))).otherwise(_legacy(name, game_id))
    return F.substring(F.concat(F.lit(f"{CHANNEL} — "), core), 1, 100)


def game_slug(day: Column, slot: Column, game_id: Column) -> Column:
    number = F.when(slot > 0, F.concat(F.lit("-g"), slot.cast("string"))).otherwise("")
    return F.when(day.isNull(), F.concat(F.lit("vban-game-"), game_id.cast("string"))).otherwise(F.concat(F.lit("vban-"), F.date_format(day, "yyyy-MM-dd"), number))


def played_on(instant: Column, zone: str) -> Column:
    """The local night of an instant."""
    return F.to_date(F.from_utc_timestamp(instant, zone))


def range_start(key: str, now: Column, zone: str) -> Column:
    """Start of today, of the week from Sunday or of the month in a zone, as UTC; null for all time."""
    day = F.to_date(F.from_utc_timestamp(now, zone))
    start = {"today": day, "week": F.date_sub(day, F.dayofweek(day) - 1), "month": F.trunc(day, "month")}.get(key)
    return F.to_utc_timestamp(start.cast("timestamp"), zone) if start is not None else F.lit(None).cast("timestamp")


def hour_label(hour: Column) -> Column:
    """12 AM, 3 PM."""
    return F.concat(F.when(hour % 12 == 0, 12).otherwise(hour % 12).cast("string"), F.when(hour < 12, " AM").otherwise(" PM"))


def visitor_hash(salt: str, day: Column, address: Column) -> Column:
    """Twelve hex digits of a day's salted address; of a forwarded list the first address counts."""
    first = F.trim(F.element_at(F.split(address, ","), 1))
    return F.substring(F.sha2(F.concat(F.lit(salt), day.cast("string"), first), 256), 1, 12)


def efficiency_text(value: Column) -> Column:
    """.421 or -.083."""
    shown = F.regexp_replace(F.format_number(F.abs(value), 3), "^0", "")
    return F.when(value < 0, F.concat(F.lit("-"), shown)).otherwise(shown)


def plural(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many or one + 's'}"))


def join_names(names: Column) -> Column:
    """A, B & C."""
    n = F.size(names)
    return F.when(n <= 1, F.coalesce(F.get(names, F.lit(0)), F.lit(""))).otherwise(F.concat(F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(" & "), F.element_at(names, -1)))


def outcome_tone(outcome: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in OUTCOMES.items() for x in kv))[outcome]


def touch_family(kind: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in FAMILY.items() for x in kv))[kind], kind)


def json_array(text: Column, kind: str) -> Column:
    """A JSON text as an array; bad JSON gives an empty one."""
    return F.coalesce(F.from_json(text, f"array<{kind}>"), F.expr(f"cast(array() as array<{kind}>)"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def rounded(v: Column, digits: int = 5) -> Column:
    return F.transform(v, lambda x: F.round(x, digits))
