"""Events, distances, rounds, grades and pools from text, as Columns; the same rules as SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

#: Metres of the units in which distances are written.
UNIT_METRES = {"m": 1.0, "meters": 1.0, "k": 1000.0, "km": 1000.0, "mi": 1609.344, "mile": 1609.344, "miles": 1609.344, "y": 0.9144, "yd": 0.9144, "yards": 0.9144}
_DISTANCE = r"([0-9]+(?:[.,][0-9]+)?)\s*(miles|mile|mi|meters|km|k|m|yards|yd|y)\b"
#: Class words and the grade they stand for.
CLASS_WORDS = {"fr": "FR", "freshman": "FR", "so": "SO", "sophomore": "SO", "jr": "JR", "junior": "JR", "sr": "SR", "senior": "SR", "rs": "RS", "redshirt": "RS"}
COLLEGE = ("FR", "SO", "JR", "SR", "RS")


def _lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def metres_of(event: Column, low: float = 0.0, high: float = 100_000.0) -> Column:
    """Metres of the first distance that an event's title names; null where there is none, or it is a relay, hurdles or field event, or out of range."""
    e = F.lower(event)
    number = F.regexp_replace(F.regexp_extract(e, _DISTANCE, 1), ",", "").try_cast("double")
    metres = number * _lookup(UNIT_METRES, F.regexp_extract(e, _DISTANCE, 2))
    other = e.rlike(r"relay|\dx|hurdle|steeple|jump|vault|throw|shot|discus|javelin|hammer|decathlon|heptathlon")
    return F.when(~other & metres.between(low, high), metres)


def within(value: Column, standard: Column, tolerance: float) -> Column:
    """Whether a distance lies in the band of a standard one."""
    return value.between(standard * (1 - tolerance), standard * (1 + tolerance))


def standard_of(metres: Column, standards: list[float], tolerance: float) -> Column:
    """The standard distance whose band holds ``metres``, the smallest of several; null if none."""
    return F.coalesce(*[F.when(within(metres, F.lit(s), tolerance), F.lit(s)) for s in sorted(standards)])


def round_of(event: Column) -> Column:
    """Round of an event's short name: final, semi, prelim, or null."""
    e = F.lower(event)
    return F.when(e.rlike("semi"), "semi").when(e.rlike("prelim|heat"), "prelim").when(e.rlike("final"), "final")


#: The words that mark an event for wheelchair and ambulatory athletes.
CHAIR_WORDS = ("wheelchair", "seated", "ambulator")


def chair_class(event: Column) -> Column:
    return F.coalesce(F.lower(event).rlike("|".join(CHAIR_WORDS)), F.lit(False))


def meet_class(name: Column) -> Column:
    """champs, invitational, dual or other, by a meet's name."""
    n = F.lower(name)
    return F.when(n.rlike(r"champ|state|nation|region|section"), "champs").when(n.rlike(r"\binv"), "invitational").when(n.rlike(r"\bvs\.?\b|dual|tri[- ]meet"), "dual").otherwise("other")


#: What may stand after a grade's number.
NUMBER_ENDS = ("", "st", "nd", "rd", "th", "t")


def norm_grade(grade: Column) -> Column:
    """A grade's canonical key: '9'..'12' style numbers (ordinals and leading zeros read), FR SO JR SR RS for class words; else as it stands."""
    g = F.trim(grade)
    low = F.lower(g)
    head = F.lower(F.rtrim(F.regexp_replace(F.split_part(g, F.lit("-"), F.lit(1)), r"[. ]+$", "")))
    after = F.ltrim(low, F.lit("0123456789"))  # what is left behind the leading digits
    number = F.substr(low, F.lit(1), F.length(low) - F.length(after)).try_cast("int")
    known = F.when(F.endswith(after, F.lit(".")), F.substr(after, F.lit(1), F.length(after) - 1)).otherwise(after).isin(*NUMBER_ENDS)
    return F.coalesce(_lookup(CLASS_WORDS, head), F.when(known & (number < 100), number.cast("string")), g)


def level_of(grade: Column) -> Column:
    """ms, hs or college, null for a grade that tells none."""
    g = norm_grade(grade)
    n = g.try_cast("int")
    return F.when(g.isin(*COLLEGE), "college").when(n.between(6, 8), "ms").when(n.between(9, 12), "hs")


def pool_of(grade: Column, gender: Column) -> Column:
    """level_gender, with unknown_level and unknown_gender."""
    sex = F.upper(F.trim(gender))
    return F.when(level_of(grade).isNull(), "unknown_level").otherwise(F.concat_ws("_", level_of(grade), F.when(sex == "M", "m").when(sex == "F", "f").otherwise("unknown_gender")))


def settle_level(by_grade: Column, by_season: Column) -> Column:
    """The level of a row whose grade and season disagree: the season's, but a college grade isn't taken down to hs by a season of hs rows alone."""
    return F.when(by_grade.isNull(), by_season).when(by_season.isNull() | (by_grade == by_season), by_grade).when((by_grade == "college") & (by_season == "hs"), by_grade).otherwise(by_season)


def is_grad_year(grade: Column) -> Column:
    return F.coalesce(F.trim(grade).rlike("^(19|20)[0-9]{2}$"), F.lit(False))


def register(spark: SparkSession) -> None:
    """Temporary SQL functions: norm_name(text), class_grade(text), band_grade(text), is_grad_year(text)."""
    words = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CLASS_WORDS.items())
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION norm_name(x STRING) RETURNS STRING RETURN trim(regexp_replace(lower(x), '[^a-z0-9]+', ' '))")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION class_grade(x STRING) RETURNS STRING RETURN CASE lower(trim(x)) {words} END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION band_grade(x STRING) RETURNS INT RETURN try_cast(split_part(x, '-', 2) AS INT)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION is_grad_year(x STRING) RETURNS BOOLEAN RETURN coalesce(trim(x) RLIKE '^(19|20)[0-9]{2}$', false)")
