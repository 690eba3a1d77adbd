"""Expressions over file names, identifiers and titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name patterns of the corpus layout.
SEASON_METADATA_NAME = r"^S\d{1,2}_metadata\.json$"
EPISODE_CODE = r"(?i)S(\d{1,2})E(\d{1,2})"
ILLEGAL_NAME_CHARS = r'[<>:"/\\|?*]'
# Fetch outcomes that end the work on an episode.
SKIP_STATUSES = ("N/A", "NSF", "NTF", "SNE", "RNE")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def decoded_path(path: Column) -> Column:
    """File paths in metadata columns are URL-encoded; a plus sign is itself there."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _code_part(text: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract(text, pattern, group)
    number = F.nullif(found, F.lit("")).cast("int")
    return F.when(number == 0, F.lit(1)).otherwise(number)


def season_number(text: Column, pattern: str = EPISODE_CODE) -> Column:
    """First season number in the name, 0 counts as 1, null where the name has no code."""
    return _code_part(text, pattern, 1)


def episode_number(text: Column, pattern: str = EPISODE_CODE) -> Column:
    return _code_part(text, pattern, 2)


def title_has_episode(title: Column, episode: Column) -> Column:
    """Zero-padded code below ten, plain code above; digits may not follow, so E1 does not match E12."""
    code = F.concat(F.lit("E"), F.when(episode.between(1, 9), F.lpad(episode.cast("string"), 2, "0"))
                    .otherwise(episode.cast("string")))
    return F.regexp_like(title, F.concat(code, F.lit(r"(?!\d)")))


def sanitise(name: Column) -> Column:
    return F.regexp_replace(name, ILLEGAL_NAME_CHARS, "_")


def archive_name(title: Column, season: Column, episode: Column) -> Column:
    return F.concat(F.replace(title, F.lit(" "), F.lit("_")), F.lit("S"), season.cast("string"), F.lit("E"),
                    episode.cast("string"), F.lit(".zip"))


def numeric_id(identifier: Column, prefix: str = "tt") -> Column:
    """Remove every occurrence of the prefix; null where no whole number is left."""
    return F.replace(identifier, F.lit(prefix), F.lit("")).try_cast("bigint")
