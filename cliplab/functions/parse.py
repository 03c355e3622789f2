"""Column functions that turn file names, time texts and ids into typed values."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cliplab.schema import SIZE_CODES, SIZE_DISPLAY


def try_int(c: Column) -> Column:
    return c.try_cast("int")


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with `value` computed once a row, also where `body` uses it in array functions."""
    return F.get(F.transform(F.array(value), body), 0)


# ------------------------------------------------------------------ time text


def hms_to_seconds(text: Column) -> Column:
    """'H:M:S[.f]' to seconds; null when it cannot be read."""
    parts = F.split(F.trim(text.cast("string")), ":")
    h, m = F.get(parts, 0).try_cast("int"), F.get(parts, 1).try_cast("int")
    return h * 3600.0 + m * 60.0 + F.get(parts, 2).try_cast("double")


def _is_number(text: Column, width: int | None = None) -> Column:
    """Digits only, `width` of them if given."""
    digits = (F.length(text) > 0) & (F.translate(text, "0123456789", "") == "")
    return digits if width is None else digits & (F.length(text) == width)


def parse_timestamp(text: Column) -> Column:
    """Strict 'H:MM:SS[.f]' or 'M:SS[.f]' with dot or comma decimals; null otherwise.

    The first field has any number of digits, the others two.  Callers that must not lose rows split on
    null and keep the rejects.
    """
    fields = F.split(F.translate(F.trim(text.cast("string")), ",", "."), ":")
    n = F.size(fields)
    lead, last = F.get(fields, 0), F.get(fields, n - 1)
    seconds = F.split(last, r"\.")
    second_ok = _is_number(F.get(seconds, 0), 2) & (
        (F.size(seconds) == 1) | ((F.size(seconds) == 2) & _is_number(F.get(seconds, 1)))
    )
    minute_ok = (n == 2) | ((n == 3) & _is_number(F.get(fields, 1), 2))
    scale = F.when(n == 3, 3600.0).otherwise(60.0)
    middle = F.when(n == 3, F.get(fields, 1).try_cast("int") * 60.0).otherwise(0.0)
    value = lead.try_cast("bigint") * scale + middle + last.try_cast("double")
    return F.when(_is_number(lead) & minute_ok & second_ok, value)


def seconds_to_text(seconds: Column) -> Column:
    """Seconds to 'HH:MM:SS.ss'."""
    rest = seconds - F.floor(seconds / 60) * 60
    return F.format_string(
        "%02d:%02d:%05.2f",
        F.floor(seconds / 3600).cast("bigint"),
        (F.floor(seconds / 60) % 60).cast("bigint"),
        rest.cast("double"),
    )


# Letters read for digits, and what else a stopwatch may show.
LOOKALIKES = ("OSIL", "0511")
NOT_STOPWATCH = r"[^0-9:\-\n ]"


def clean_stopwatch_text(text: Column) -> Column:
    """Upper-case, map letters read for digits, blank out everything else."""
    return F.regexp_replace(F.translate(F.upper(text), *LOOKALIKES), NOT_STOPWATCH, " ")


def _clock_readings(text: Column, units: tuple[int, ...], starts: Callable[..., Column]) -> Column:
    """Seconds of all clock readings in a cleaned text, left to right without overlap.

    The text is read as numbers and the gaps around them (gap i stands before number i).  `starts(number, gap, i)`
    says whether a reading of len(units) numbers begins at number i.
    """
    numbers = F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))
    parts = F.struct(numbers.alias("numbers"), F.split(text, "[0-9]+").alias("gaps"))

    def read(part: Column) -> Column:
        def number(i: Column) -> Column:
            return F.get(part["numbers"], i)

        def gap(i: Column) -> Column:
            return F.get(part["gaps"], i)

        def seconds(i: Column) -> Column:
            return reduce(lambda a, b: a + b, [number(i + k).try_cast("bigint") * unit for k, unit in enumerate(units)])

        def take(state: Column, i: Column) -> Column:
            taken = F.struct((i + len(units)).alias("free"), F.concat(state["found"], F.array(seconds(i))).alias("found"))
            return F.when(i >= state["free"], taken).otherwise(state)

        n = F.size(part["numbers"])
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        places = F.filter(places, lambda i: F.coalesce(starts(number, gap, i), F.lit(False)))
        start = F.struct(F.lit(0).alias("free"), F.array().cast("array<bigint>").alias("found"))
        return F.aggregate(places, start, take, lambda state: state["found"])

    return _once(parts, read)


def _sixtieth(number: Column) -> Column:
    """Two digits below sixty."""
    return (F.length(number) == 2) & (number < "60")


def _starts_hours(number: Callable, gap: Callable, i: Column) -> Column:
    """'HH:MM:SS' without blanks."""
    tight = (gap(i + 1) == ":") & (gap(i + 2) == ":")
    return tight & (F.length(number(i)) == 2) & _sixtieth(number(i + 1)) & _sixtieth(number(i + 2))


def _starts_minutes(number: Callable, gap: Callable, i: Column) -> Column:
    """'M:SS' to 'MMM:SS', with blanks around the colon or not, that isn't a part of a longer tight reading."""
    colon = F.translate(gap(i + 1), " \n", "") == ":"
    continued = (i > 0) & (gap(i) == ":")
    continues = number(i + 2).isNotNull() & (gap(i + 2) == ":")
    return colon & (F.length(number(i)) <= 3) & _sixtieth(number(i + 1)) & ~continued & ~continues


def stopwatch_seconds(text: Column, minutes_only: Column | bool = False, hint: Column | None = None) -> Column:
    """Seconds on a stopwatch overlay, or null.

    Hour readings go before minute readings, unless `minutes_only`.  Of several readings the one
    nearest to the hint modulo one hour is taken (the first on ties); without hint the first within
    hour zero if it is an hour reading, else the last.
    """
    cleaned = clean_stopwatch_text(text)
    target = (F.lit(None) if hint is None else hint).cast("double") % 3600.0

    def choose(readings: Column, unhinted: Column) -> Column:
        by_distance = F.transform(
            readings, lambda v, i: F.struct(F.abs((v % 3600).cast("double") - target).alias("d"), i.alias("i"), v.alias("v"))
        )
        return F.when(target.isNull(), unhinted).otherwise(F.array_min(by_distance)["v"])

    minutes = _clock_readings(cleaned, (60, 1), _starts_minutes)
    hours = _clock_readings(cleaned, (3600, 60, 1), _starts_hours)
    last = lambda a: F.get(a, F.size(a) - 1)
    by_minutes = choose(minutes, last(minutes))
    by_hours = choose(hours, F.coalesce(F.get(F.filter(hours, lambda v: v < 3600), 0), last(hours)))
    use_hours = (F.size(hours) > 0) & ~(minutes_only if isinstance(minutes_only, Column) else F.lit(minutes_only))
    return F.when(F.coalesce(use_hours, F.lit(False)), by_hours).otherwise(by_minutes)


# ------------------------------------------------------------------------ ids


def segment_number(segment_id: Column) -> Column:
    """Integer after the last '_', or -1."""
    return F.coalesce(try_int(F.element_at(F.split(segment_id, "_"), -1)), F.lit(-1))


def frame_number(name: Column) -> Column:
    """Integer after the last '_' of a .jpg / .png name, or -1."""
    stem = F.replace(F.replace(name, F.lit(".jpg"), F.lit("")), F.lit(".png"), F.lit(""))
    return segment_number(stem)


# Sources in file names, and what stands before the frame number.
SAMPLE_SOURCES = ("sample", "ulcer_NonUlcer", "ulcer_Ulcer")
FRAME_MARK = "frame_"


def sample_name(stem: Column) -> Column:
    """struct(record_id, unique_sample_id, frame_number) of '<record>__<source>_<n>__frame_<n>', or null.

    Fields stand between double underscores (the last two of a longer run), in any case; the record is all
    before the first field that is a source with a number and has a frame after it.  What follows the frame
    number is left out.
    """
    def numbered_source(field: Column) -> Column:
        number = F.substring_index(field, "_", -1)
        source = F.substring(field, F.lit(1), F.length(field) - F.length(number) - 1)
        return F.lower(source).isin([s.lower() for s in SAMPLE_SOURCES]) & _is_number(number)

    def frame_digits(field: Column) -> Column:
        after = F.substring(field, F.lit(len(FRAME_MARK) + 1), F.length(field))
        return F.when(F.lower(field).startswith(FRAME_MARK), F.regexp_extract(after, "^[0-9]+", 0))

    def place(fields: Column) -> Column:
        def found(i: Column) -> Column:
            named = (i > 1) | (F.length(F.get(fields, 0)) > 0)
            return named & numbered_source(F.get(fields, i)) & (F.length(frame_digits(F.get(fields, i + 1))) > 0)

        last = F.size(fields) - 2
        places = F.when(last >= 1, F.sequence(F.lit(1), last))
        first = F.get(F.filter(places, lambda i: F.coalesce(found(i), F.lit(False))), 0)
        return F.struct(fields.alias("fields"), first.alias("at"))

    def read(placed: Column) -> Column:
        fields, at = placed["fields"], placed["at"]
        return F.when(
            at.isNotNull(),
            F.struct(
                F.array_join(F.slice(fields, 1, at), "__").alias("record_id"),
                F.get(fields, at).alias("unique_sample_id"),
                frame_digits(F.get(fields, at + 1)).try_cast("int").alias("frame_number"),
            ),
        )

    return _once(_once(F.split(stem, "__(?!_)"), place), read)


def normalize_video_id(video_id: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(F.trim(video_id)), "-", "_"), r"\s+", "")


def clip_key(video_id: Column, segment_id: Column) -> Column:
    return F.concat_ws("__", video_id.cast("string"), segment_id.cast("string"))


def path_component(path: Column, index: int) -> Column:
    """Zero-based component of a '/'-separated path, or null."""
    return F.get(F.split(path, "/"), index)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def is_media_file(path: Column, extensions: tuple[str, ...] = (".jpg", ".jpeg", ".png")) -> Column:
    """Known extension in any case, and not a dot-file."""
    name = F.element_at(F.split(path, "/"), -1)
    choices = "|".join(e.lstrip(".") for e in extensions)
    return name.rlike(rf"(?i)\.({choices})$") & ~name.startswith(".")


# --------------------------------------------------------------- sizes, strata


def _lookup(pairs: Mapping, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[key]


def size_code(text: Column) -> Column:
    return _lookup(SIZE_CODES, F.trim(text))


def size_label(code: Column) -> Column:
    return F.coalesce(_lookup({v: k for k, v in SIZE_CODES.items()}, code.cast("int")), F.lit("unknown"))


def size_rank(label: Column) -> Column:
    """Position in display order."""
    return _lookup({s: i for i, s in enumerate(SIZE_DISPLAY)}, label)


def cause_stratum(label: Column, cause: Column) -> Column:
    """'informative', or 'non_informative__<cause with underscores>' ('none' without a cause)."""
    text = F.trim(F.coalesce(cause, F.lit("")))
    slug = F.when(text == "", "none").otherwise(F.regexp_replace(text, r"\s+", "_"))
    return F.when(label == 1, "informative").otherwise(F.concat_ws("__", F.lit("non_informative"), slug))


def safe_cause(cause: Column) -> Column:
    """Folder-safe cause name; 'Unknown' if nothing is left."""
    slug = F.trim(F.regexp_replace(F.trim(cause), r"[^\p{L}\p{N}_\-]", "_"), F.lit("_"))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("Unknown"))


# Suffixes that name a training mode.
MODEL_SUFFIXES = ("-allBackbone", "-freezeBackbone", "-9Backbone")


def model_display_name(name: Column, overrides: Mapping[str, str] | None = None) -> Column:
    short = F.regexp_replace(name, "|".join(MODEL_SUFFIXES), "")
    return F.coalesce(_lookup(overrides, short), short) if overrides else short
