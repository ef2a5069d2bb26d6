"""Date phrases as intervals with the precision that they state, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_NAMES = "january|february|march|april|may|june|july|august|september|sept|october|november|december|" + "|".join(m for m in MONTHS if m != "may")
_DAYS = "monday|tuesday|wednesday|thursday|friday|saturday|sunday|mon|tues|tue|wed|thurs|thur|thu|fri|sat|sun"
_TIME = r"(?:[t ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:z| ?utc|[+-]\d{2}:?\d{2})?)?"

#: Pattern of the whole phrase and the groups of year, month and day in it (0: not stated); a month is a name or a number.
_FORMS = (
    (rf"^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}}){_TIME}$", 1, 2, 3),
    (rf"^(\d{{1,2}})[ -]?({_NAMES})[ -](\d{{4}}){_TIME}$", 3, 2, 1),
    (rf"^({_NAMES})[ -](\d{{1,2}})[ -](\d{{4}}){_TIME}$", 3, 1, 2),
    (rf"^(\d{{4}})[ -]({_NAMES})[ -](\d{{1,2}})$", 1, 2, 3),
    (rf"^({_NAMES})[ -](\d{{4}})$", 2, 1, 0),
    (rf"^(\d{{4}})[ -]({_NAMES})$", 1, 2, 0),
    (r"^(\d{4})[-/](\d{1,2})$", 1, 2, 0),
    (r"^(\d{1,2})[-/](\d{4})$", 2, 1, 0),
    (r"^(\d{4})$", 1, 0, 0),
)
#: Numbers only, month first unless that can't be.
_SLASHED = rf"^(\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{4}}){_TIME}$"

QUARTER = r"(?i)\bQ([1-4])\s*,?\s*(?:of\s+)?(\d{4})\b"
BETWEEN = r"(?i)\bbetween\s+(.+?)\s+and\s+(.+)$"
SINCE = r"(?i)\b(?:since|from|after)\s+(.+)$"
HEDGE = r"(?i)\b(early|mid|late|beginning\s+of|start\s+of|end\s+of|middle\s+of)\b[\s\-]*"
#: Which third of a period a hedge points at (fixed values).
THIRDS = {"early": 0, "beginning": 0, "start": 0, "mid": 1, "middle": 1, "late": 2, "end": 2}


def _let(value: Column, use) -> Column:
    """use(value), in which value is worked out once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _span(year: Column, month: Column, day: Column) -> Column:
    """t_start, t_end, precision of a day, month or year; null if there is no such day."""
    ok = year.between(1, 9999) & F.coalesce(month, F.lit(1)).between(1, 12)
    precision = F.when(day.isNotNull(), "day").when(month.isNotNull(), "month").otherwise("year")
    at = lambda d: d.cast("timestamp_ntz")

    def whole(start: Column) -> Column:
        stop = F.when(day.isNotNull(), F.date_add(start, 1)).when(month.isNotNull(), F.add_months(start, 1)).otherwise(F.add_months(start, 12))
        return F.when(start.isNotNull(), F.struct(at(start).alias("t_start"), (at(stop) - F.expr("interval 1 microsecond")).alias("t_end"), precision.alias("precision")))

    within = lambda first: F.when(F.coalesce(day, F.lit(1)).between(1, F.dayofmonth(F.last_day(first))), F.date_add(first, F.coalesce(day, F.lit(1)) - 1))
    first = F.when(ok, F.make_date(year, F.coalesce(month, F.lit(1)), F.lit(1)))
    return _let(_let(first, within), whole)


def plain(text: Column) -> Column:
    """A date as written, with day, month or year; null if it has no year or isn't a date.

    Weekdays, ordinal endings, "on" and "of" are passed over. Numbers with
    slashes have the month first, unless it is over 12.
    """
    t = F.lower(F.trim(F.regexp_replace(text, r"[\s,]+", " ")))
    t = F.regexp_replace(t, rf"^(?:on |at )?(?:(?:{_DAYS})\.? )?", "")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"(\d)(?:st|nd|rd|th)\b", "$1"), r"\bof ", ""), r"([a-z])\.", "$1")

    def parts(t: Column) -> Column:
        group = lambda pattern, i: F.regexp_extract(t, pattern, i) if i else F.lit(None).cast("string")
        form = lambda pattern, y, m, d: F.struct(group(pattern, y).alias("y"), group(pattern, m).alias("m"), group(pattern, d).alias("d"))
        found = [F.when(t.rlike(pattern), form(pattern, *at)) for pattern, *at in _FORMS]
        early = F.regexp_extract(t, _SLASHED, 1).try_cast("int") <= 12
        return F.coalesce(*found, F.when(t.rlike(_SLASHED), F.when(early, form(_SLASHED, 3, 1, 2)).otherwise(form(_SLASHED, 3, 2, 1))))

    name = lambda m: F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(m, 1, 3)).cast("int"), F.lit(0))
    numbers = lambda p: F.struct(p["y"].try_cast("int").alias("y"), F.coalesce(p["m"].try_cast("int"), name(p["m"])).alias("m"), p["d"].try_cast("int").alias("d"))
    return _let(_let(_let(t, parts), numbers), lambda n: _span(n["y"], n["m"], n["d"]))


def resolve(rows: DataFrame, text: str) -> DataFrame:
    """rows with t_start, t_end, precision and date_text of the phrase in column text; all null if it carries no usable year.

    In turn: a quarter; "between a and b", whose year also serves a if a has
    none; "since", "from" or "after" a date, which is the interval of that date;
    a hedge ("early", "mid", "late", "end of" ...), which is a third of the
    period; a date as written. A form that doesn't resolve gives way to the
    next. date_text is what was written, of at most 120 characters.
    """
    raw = F.trim(F.coalesce(F.col(text).cast("string"), F.lit("")))
    part = lambda pattern, i: F.trim(F.regexp_extract("_raw", pattern, i))
    year = F.regexp_extract("_raw", QUARTER, 2).try_cast("int")
    quarter = F.regexp_extract("_raw", QUARTER, 1).try_cast("int")
    first = F.when(year >= 1, F.make_date(year, 3 * quarter - 2, F.lit(1)))
    q = F.when(first.isNotNull(), F.struct(first.cast("timestamp_ntz").alias("t_start"), (F.add_months(first, 3).cast("timestamp_ntz") - F.expr("interval 1 microsecond")).alias("t_end"), F.lit("month").alias("precision")))
    # each phrase that has to be read as a date is read once, in a projection of its own
    out = rows.withColumn("_raw", raw).withColumn("_q", q).withColumn("_right", plain(part(BETWEEN, 2)))
    out = out.withColumn("_left", F.when(F.col("_right").isNotNull(), plain(part(BETWEEN, 1))))
    out = out.withColumn("_left", F.when(F.col("_right").isNotNull(), F.coalesce("_left", plain(F.concat_ws(" ", part(BETWEEN, 1), F.date_format("_right.t_start", "yyyy"))), "_right")))
    both = F.when(F.col("_right").isNotNull(), F.struct(F.col("_left.t_start").alias("t_start"), F.col("_right.t_end").alias("t_end"), F.col("_right.precision").alias("precision")))
    out = out.withColumn("_since", plain(part(SINCE, 1))).withColumn("_word", F.lower(F.regexp_extract(part(HEDGE, 1), r"^(\w+)", 1)))
    out = out.withColumn("_of", F.when(F.col("_word") != "", plain(F.regexp_replace("_raw", HEDGE, "")))).withColumn("_plain", plain(F.col("_raw")))
    third = F.coalesce(*[F.when(F.col("_word") == w, F.lit(i)) for w, i in THIRDS.items()])
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    total = micros(F.col("_of.t_end")) - micros(F.col("_of.t_start"))
    at = lambda k: F.timestamp_micros(micros(F.col("_of.t_start")) + F.round(total * k / 3).cast("long")).cast("timestamp_ntz")
    hedged = F.when(F.col("_of").isNotNull(), F.struct(at(third).alias("t_start"), at(third + 1).alias("t_end"), F.col("_of.precision").alias("precision")))
    out = out.withColumn("_found", F.coalesce("_q", both, "_since", hedged, "_plain"))
    label = F.when(F.col("_found").isNotNull(), F.substring("_raw", 1, 120))
    return out.select(*rows.columns, F.col("_found.t_start").alias("t_start"), F.col("_found.t_end").alias("t_end"), F.col("_found.precision").alias("precision"), label.alias("date_text"))


def absorb(entities: DataFrame, relationships: DataFrame, events: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Dates that become properties of the events that they date.

    entities: name, entity_type (of equal names the last by position counts);
    relationships: position, source_name, target_name, rel_type. OCCURRED_ON
    edges are turned so that the date is the target. An event that only an edge
    names is made. Of several dates of an event, the first by position that
    resolves counts. events says which entity_type is an event ("Event" if not
    given). Gives the events with a date (name, t_start, t_end, precision,
    date_text, made), the relationships as turned, and the names of dates that
    were absorbed.
    """
    is_event = F.col("entity_type") == "Event" if events is None else events
    known = entities.filter("name <> ''").groupBy("name").agg(F.max_by("entity_type", "position").alias("entity_type"))
    side = lambda c, p: known.select(F.col("name").alias(c), F.col("entity_type").alias(f"{p}_type"))
    edges = relationships.join(side("source_name", "s"), "source_name", "left").join(side("target_name", "t"), "target_name", "left")
    turn = (F.col("rel_type") == "OCCURRED_ON") & F.coalesce(F.col("s_type") == "Date", F.lit(False)) & ~F.coalesce(F.col("t_type") == "Date", F.lit(False))
    pick = lambda a, b: F.when(turn, F.col(b)).otherwise(F.col(a))
    turned = edges.select(*[c for c in relationships.columns if c not in ("source_name", "target_name")], pick("source_name", "target_name").alias("source_name"), pick("target_name", "source_name").alias("target_name"), pick("s_type", "t_type").alias("_s"), pick("t_type", "s_type").alias("_t"))
    dated = turned.filter("rel_type = 'OCCURRED_ON' and _t = 'Date'").select("position", F.trim("source_name").alias("name"), "target_name", F.col("_s").alias("entity_type"), F.col("_s").isNull().alias("made"))
    dated = dated.filter((F.col("name") != "") & (F.col("made") | is_event))
    found = resolve(dated, "target_name").filter("t_start is not null")
    first = found.withColumn("_r", F.row_number().over(Window.partitionBy("name").orderBy("position", "target_name"))).filter("_r = 1")
    return first.select("name", "t_start", "t_end", "precision", "date_text", "made"), turned.select(*relationships.columns), first.select(F.col("target_name").alias("name")).distinct()
