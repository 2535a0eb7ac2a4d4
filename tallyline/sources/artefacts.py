"""Artefacts whose fields are only known from their documents: variants and one schema merged over all of them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .flatten import season_series_rows, shift_rows

# fields that a series document may lack altogether
_TEAM = T.StructType([T.StructField("abbrev", T.StringType()), T.StructField("score", T.LongType())])
SERIES = T.StructType(
    [
        T.StructField(
            "seasonSeries",
            T.ArrayType(
                T.StructType(
                    [T.StructField("id", T.LongType())] + [T.StructField(n, T.StringType()) for n in ("gameDate", "gameState")]
                    + [T.StructField(n, _TEAM) for n in ("awayTeam", "homeTeam")]
                )
            ),
        ),
        T.StructField("gameInfo", T.VariantType()),
    ]
)


def merged_type(docs: DataFrame, text: str = "text") -> str:
    """The type that holds every document of ``docs``, as DDL: all fields that occur, types widened where documents differ.

    One aggregation over all documents; fields of types that nothing holds in
    common stay variants, fields that are always null are text. Text that is no
    JSON counts as null.
    """
    seen = docs.agg(F.schema_of_variant_agg(F.try_parse_json(text)).alias("t")).first()["t"]
    # names in back quotes are left alone
    parts = re.split(r"(`(?:[^`]|``)*`)", seen or "VOID")
    return "".join(p if p.startswith("`") else re.sub(r"\bVOID\b", "STRING", p.replace("OBJECT<", "STRUCT<")) for p in parts)


def shift_table(docs: DataFrame) -> DataFrame:
    """Shift entries with every field found in any document, beside ``game_id`` and ``season`` of the document.

    ``docs`` has ``game_id``, ``season`` and ``text`` with an array ``data``.
    The document's own ids win over fields of the same name in an entry.
    Documents without entries give no row; without any entry at all the table
    has the two ids only.
    """
    entries = docs.select("game_id", "season", F.explode(F.try_variant_get(F.try_parse_json("text"), "$.data", "array<variant>")).alias("e"))
    # the documents are made and parsed once: the merged type and the rows both read the parsed entries
    entries = materialise(entries, "shift-entries")
    # their text again, because a whole decimal counts as a whole number only as text
    kind = merged_type(entries.select(F.to_json("e").alias("text")))
    if not kind.startswith("STRUCT<") or kind == "STRUCT<>":
        return entries.select("game_id", "season").filter(F.lit(False))
    return shift_rows(entries.select("game_id", "season", F.array(F.try_variant_get("e", "$", kind)).alias("data")))


def series_table(docs: DataFrame) -> DataFrame:
    """Meetings and information rows of series documents; the information keeps its own shape as JSON text."""
    parsed = docs.select("game_id", "season", F.from_json("text", SERIES).alias("d")).select("game_id", "season", "d.*")
    return season_series_rows(parsed.withColumn("gameInfo", F.to_json("gameInfo")))
