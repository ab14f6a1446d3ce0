"""Airport profiles from the four files of a subscription cycle: airports, runways, runway ends, frequencies.

All files meet in one shuffle on the airport's id (``relational.gathered``);
an airport has some dozens of rows, so what pairs and orders them works on its
own arrays. Columns of the files are text, as they come from CSV, and ``line``
orders a file's rows. Unreadable numbers are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squelch.functions.text import spoken_digits, title_words
from squelch.operators.folds import let
from squelch.operators.relational import gathered

#: The first words of a frequency's use, its service, and what is said after the facility's name.
SERVICES = (
    ("LCL", "TWR", "Tower"), ("GND", "GND", "Ground"), ("CD", "CD", "Clearance Delivery"), ("D-ATIS", "ATIS", "ATIS"), ("ATIS", "ATIS", "ATIS"),
    ("APCH", "APP", "Approach"), ("DEP", "DEP", "Departure"), ("CLASS B", "CLASS_B", "Approach"), ("EMERG", "EMERG", "Emergency"),
)
#: Services called by the approach facility's name; services whose calls are aliases; the order in which services are shown.
APPROACH_SERVICES, CALLED_SERVICES = ("APP", "DEP", "CLASS_B", "PROC"), ("TWR", "GND", "CD", "APP", "DEP")
SHOWN_ORDER = ("TWR", "GND", "CD", "ATIS", "APP", "DEP", "CLASS_B", "PROC", "EMERG", "OTHER")
#: The voice band in MHz (upper end excluded), and sides of parallel runways.
VOICE_BAND, SIDES = (108.0, 137.0), {"L": "left", "R": "right", "C": "center"}


def _number(text: str, kind: str = "double") -> Column:
    """A number from text; a whole number is cut, not rounded."""
    return F.col(text).try_cast("double").cast(kind)


def _full(text: Column) -> Column:
    """The text, null where it is empty."""
    return F.nullif(text, F.lit(""))


def _joined(*parts: Column) -> Column:
    """The parts that say anything, with a blank between them."""
    return F.array_join(F.filter(F.array(*parts), lambda p: F.coalesce(p, F.lit("")) != ""), " ")


def spoken_runway(ident: Column) -> Column:
    """How a runway end is said: with niner, then with nine where that differs."""
    digits = F.regexp_replace(ident, "[^0-9]", "")
    side = F.element_at(F.create_map(*[F.lit(x) for pair in SIDES.items() for x in pair]), F.upper(F.trim(F.substr(ident, F.char_length(digits) + 1))))
    said = lambda icao: _joined(F.lit("runway"), spoken_digits(digits, icao), side)
    return F.array_distinct(F.array(said(True), said(False)))


def spoken_frequency(mhz: Column) -> Column:
    """How a frequency is said: niner and point, nine and point, niner and decimal; each form once."""
    whole, fraction = F.substring_index(mhz, ".", 1), F.when(F.instr(mhz, ".") > 0, F.regexp_replace(F.substr(mhz, F.instr(mhz, ".") + 1), "0+$", ""))
    fraction = F.coalesce(_full(fraction), F.lit("0"))
    said = lambda icao, mark: F.concat(spoken_digits(whole, icao), F.lit(f" {mark} "), spoken_digits(fraction, icao))
    return F.array_distinct(F.array(said(True, "point"), said(False, "point"), said(True, "decimal")))


def voice_frequencies(frequencies: DataFrame) -> DataFrame:
    """faa_id and a struct ``f`` of each frequency in the voice band that is no airport remark."""
    use = F.trim(F.coalesce("FREQ_USE", F.lit("")))
    mhz, loud = _number("FREQ"), F.upper(use)
    service, suffix = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for prefix, name, said in SERVICES:
        service, suffix = service.when(loud.startswith(prefix), name), suffix.when(loud.startswith(prefix), said)
    procedure = loud.endswith(" STAR") | loud.endswith(" DP")
    service, suffix = service.when(procedure, "PROC").otherwise("OTHER"), suffix.when(procedure, "Approach").otherwise("")
    kept = frequencies.filter((mhz >= VOICE_BAND[0]) & (mhz < VOICE_BAND[1]) & ~use.startswith("APT REMARK"))
    fields = {
        "line": F.col("line"), "service": service, "suffix": suffix, "hz": F.rint(mhz * 1_000_000).cast("long"), "khz": F.rint(mhz * 1000).cast("long"), "facility": _full(F.col("FACILITY")),
        "sector": _joined(use, F.trim(F.coalesce("SECTORIZATION", F.lit("")))), "approach_call": title_words(F.coalesce("PRIMARY_APPROACH_RADIO_CALL", F.lit(""))),
        "tower_call": title_words(F.coalesce("TOWER_OR_COMM_CALL", F.lit(""))), "spoken": spoken_frequency(F.col("FREQ")),
    }
    return kept.select(F.col("SERVICED_FACILITY").alias("faa_id"), F.struct(*[v.alias(k) for k, v in fields.items()]).alias("f"))


def _called(f: Column, tower: Column) -> Column:
    name = F.when(f["service"].isin(*APPROACH_SERVICES), f["approach_call"]).otherwise(F.coalesce(_full(f["tower_call"]), tower))
    return F.when((f["suffix"] != "") & (f["service"] != "EMERG"), _joined(name, f["suffix"]))


def _frequencies(tower: Column) -> Column:
    """One struct for each service, kHz and sector, as the last such row says; by service and frequency, then by where it came first."""
    found = F.array_sort("frequencies")
    key = lambda f: F.struct(f["service"], f["khz"], f["sector"])

    def settled(k: Column) -> Column:
        same = F.filter(found, lambda f: key(f) == k)
        first = F.get(same, F.lit(0))["line"]
        return let(F.get(same, F.size(same) - 1), lambda f: F.struct(
            f["service"].alias("service"), f["hz"].alias("frequency_hz"), first.alias("line"), f["facility"].alias("facility"),
            _called(f, tower).alias("call"), _full(f["sector"]).alias("sectorization"), f["spoken"].alias("spoken"),
        ))

    return F.array_sort(F.transform(F.array_distinct(F.transform(found, key)), settled))


def _ends() -> Column:
    """The runway ends by pair and end, each with the length and width of its runway (the last such row)."""

    def paired(e: Column) -> Column:
        runway = F.filter(F.array_sort("runways"), lambda r: r["pair"] == e["pair"])
        return let(F.get(runway, F.size(runway) - 1), lambda r: F.struct(
            *[e[c].alias(c) for c in ("pair", "end_ident", "line")], r["length_ft"].alias("length_ft"), r["width_ft"].alias("width_ft"),
            *[e[c].alias(c) for c in ("true_alignment", "spoken", "latitude", "longitude", "elevation_ft", "displaced_latitude", "displaced_longitude")],
        ))

    return F.transform(F.array_sort("ends"), paired)


def profiles(base: DataFrame, runways: DataFrame, ends: DataFrame, frequencies: DataFrame, places: DataFrame) -> DataFrame:
    """One row for each airport of ``base``: names, place, runways, frequencies, aliases.

    ``places`` gives an airport's timezone (never guessed; null if unknown) and
    the station labels that stand for it (its own id, if none). Rows of the
    other files whose airport isn't in ``base`` are left out, rows without an
    airport too. Where ``base`` names an airport twice, its first line counts.
    """
    own = base.select(F.col("ARPT_ID").alias("faa_id"), F.struct("line", *[F.col(c) for c in ("ICAO_ID", "ARPT_NAME", "CITY", "LAT_DECIMAL", "LONG_DECIMAL", "ELEV", "MAG_VARN", "MAG_HEMIS", "MAG_VARN_YEAR", "EFF_DATE")]).alias("b"))
    pairs = runways.select(F.col("ARPT_ID").alias("faa_id"), F.struct("line", F.col("RWY_ID").alias("pair"), _number("RWY_LEN", "int").alias("length_ft"), _number("RWY_WIDTH", "int").alias("width_ft")).alias("r"))
    tips = ends.select(F.col("ARPT_ID").alias("faa_id"), F.struct(
        F.col("RWY_ID").alias("pair"), F.col("RWY_END_ID").alias("end_ident"), "line", _number("TRUE_ALIGNMENT").alias("true_alignment"), spoken_runway(F.col("RWY_END_ID")).alias("spoken"),
        _number("LAT_DECIMAL").alias("latitude"), _number("LONG_DECIMAL").alias("longitude"), _number("RWY_END_ELEV").alias("elevation_ft"),
        _number("LAT_DISPLACED_THR_DECIMAL").alias("displaced_latitude"), _number("LONG_DISPLACED_THR_DECIMAL").alias("displaced_longitude"),
    ).alias("e"))
    where = places.select("faa_id", F.struct("timezone", "stations").alias("p"))
    rows = gathered("faa_id", {"bases": own, "runways": pairs, "ends": tips, "frequencies": voice_frequencies(frequencies), "places": where}).filter(F.size("bases") > 0)
    rows = rows.withColumns({"b": F.array_min("bases"), "p": F.get("places", F.lit(0))})
    city = F.coalesce(_full(F.col("b.CITY")), F.col("faa_id"))
    rows = rows.withColumns({"icao": F.coalesce(_full(F.col("b.ICAO_ID")), F.concat(F.lit("K"), "faa_id")), "name": title_words(F.coalesce(_full(F.col("b.ARPT_NAME")), F.col("faa_id"))), "tower": title_words(city)})
    rows = rows.withColumns({"runways": _ends(), "frequencies": _frequencies(F.col("tower"))})
    alias = lambda of, kind: F.struct(of.alias("alias"), F.lit(kind).alias("kind"))
    stations = F.when(F.size("p.stations") > 0, F.col("p.stations")).otherwise(F.array("faa_id"))
    calls = F.transform(F.filter("frequencies", lambda f: f["call"].isNotNull() & f["service"].isin(*CALLED_SERVICES)), lambda f: alias(f["call"], "spoken"))
    first, last = F.array(alias(F.col("icao"), "icao"), alias(F.col("faa_id"), "faa")), F.array(alias(F.col("name"), "name"), alias(F.col("tower"), "spoken"))
    variation = F.when(F.coalesce("b.MAG_VARN", F.lit("")) != "", F.concat("b.MAG_VARN", F.coalesce("b.MAG_HEMIS", F.lit("")), F.lit(" ("), F.coalesce("b.MAG_VARN_YEAR", F.lit("")), F.lit(")")))
    return rows.select(
        "icao", "faa_id", F.when(F.col("faa_id").rlike(r"^\p{L}{3}$"), F.col("faa_id")).alias("iata"), "name", _full(title_words(F.coalesce("b.CITY", F.lit("")))).alias("city"),
        _number("b.LAT_DECIMAL").alias("latitude"), _number("b.LONG_DECIMAL").alias("longitude"), _number("b.ELEV").alias("elevation_ft"), variation.alias("magnetic_variation"),
        F.col("p.timezone").alias("timezone"), "runways", "frequencies", F.array_distinct(F.concat(first, F.transform(stations, lambda s: alias(s, "station")), last, calls)).alias("aliases"), F.col("b.EFF_DATE").alias("effective"),
    )


def shown_frequencies(frequencies: Column) -> Column:
    """A profile's frequencies as they are listed: by the order of services, then by frequency."""
    place = lambda f: F.array_position(F.array(*[F.lit(s) for s in SHOWN_ORDER]), f["service"])
    return F.transform(F.array_sort(F.transform(frequencies, lambda f: F.struct(place(f).alias("p"), f["frequency_hz"].alias("hz"), f.alias("f")))), lambda x: x["f"])


def drawn_runways(ends: Column) -> Column:
    """Runways that can be drawn: pairs of which exactly two ends have a place, in order, each with its two ends."""
    located = F.filter(ends, lambda e: e["latitude"].isNotNull() & e["longitude"].isNotNull())
    both = F.transform(F.array_distinct(F.transform(located, lambda e: e["pair"])), lambda p: F.struct(p.alias("pair"), F.filter(located, lambda e: e["pair"] == p).alias("ends")))
    return F.filter(both, lambda x: F.size(x["ends"]) == 2)
