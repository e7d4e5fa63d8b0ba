"""Cleaning of catalog and listening tables, with rejects and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.ordering import value_at_max
from cadenza.functions.text import blank, normalized

#: Audio columns that lie in 0..1, and all that make up a track's feature vector (fixed values).
UNIT_COLUMNS = ["danceability", "energy", "speechiness", "acousticness", "instrumentalness", "liveness", "valence"]
VECTOR_COLUMNS = ["duration_ms", "danceability", "energy", "key", "loudness", "mode", "speechiness", "acousticness", "instrumentalness", "liveness", "valence", "tempo", "time_signature"]


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds, or null. A rule that is null does not hold."""
    return reduce(lambda rest, rule: F.when(rule[1], F.lit(rule[0])).otherwise(rest), reversed(rules), F.lit(None).cast("string"))


def _track_rules() -> list[tuple[str, Column]]:
    return [(f"missing_{name}", blank(F.col(column))) for name, column in (("track_id", "track_id"), ("track_name", "track_name"), ("artists", "artists"))]


def stage_tracks(raw: DataFrame) -> DataFrame:
    """Texts trimmed; other columns as they are typed by the scan."""
    return raw.select(*[F.trim(c).alias(c) if t == "string" else F.col(c) for c, t in raw.dtypes])


def rejected_tracks(staged: DataFrame) -> DataFrame:
    """Rows without id, title or artists, with the first reason."""
    return staged.withColumn("rejection_reason", first_reason(_track_rules())).where("rejection_reason is not null")


def accepted_tracks(staged: DataFrame) -> DataFrame:
    return staged.where(first_reason(_track_rules()).isNull())


def feature_issues(staged: DataFrame) -> DataFrame:
    """Rows with a value out of range: (source_row_id, track_id, issue_reason). Null is never an issue."""
    unit = reduce(Column.__or__, [~F.coalesce(F.col(c).between(0, 1), F.lit(True)) for c in UNIT_COLUMNS])
    rules = [
        ("invalid_popularity", ~F.col("popularity").between(0, 100)),
        ("invalid_duration", F.col("duration_ms") <= 0),
        ("invalid_unit_feature", unit),
        ("invalid_key", ~F.col("key").between(-1, 11)),
        ("invalid_mode", ~F.col("mode").isin(0, 1)),
        ("missing_or_invalid_tempo", F.col("tempo") <= 0),
        ("invalid_time_signature", F.col("time_signature") <= 0),
    ]
    return staged.select("source_row_id", "track_id", first_reason(rules).alias("issue_reason")).where("issue_reason is not null")


def duplicate_audit(staged: DataFrame) -> DataFrame:
    """Ids of several accepted rows, with how many titles, artists, genres and feature vectors they have.

    A vector with null members counts as a vector.
    """
    grouped = accepted_tracks(staged).groupBy("track_id").agg(
        F.count("*").alias("source_rows"),
        F.count_distinct("track_name").alias("distinct_titles"),
        F.count_distinct("artists").alias("distinct_artist_strings"),
        F.count_distinct("track_genre").alias("distinct_genres"),
        F.count_distinct(F.struct(*VECTOR_COLUMNS)).alias("distinct_feature_vectors"),
    )
    return grouped.where("source_rows > 1")


def canonical_tracks(staged: DataFrame) -> DataFrame:
    """One row a track id: the most popular, then the least genre and row id; tempo <= 0 becomes null."""
    choice = Window.partitionBy("track_id").orderBy(F.desc_nulls_last("popularity"), F.asc_nulls_last("track_genre"), F.asc_nulls_last("source_row_id"))
    best = accepted_tracks(staged).withColumn("choice", F.row_number().over(choice)).where("choice = 1").drop("choice")
    best = best.withColumn("tempo", F.when(F.col("tempo") > 0, F.col("tempo")))
    return best.withColumns({"track_name_norm": normalized(F.col("track_name")), "artists_norm": normalized(F.col("artists"), ";")})


def track_genres(staged: DataFrame, tracks: DataFrame) -> DataFrame:
    named = staged.where(~blank(F.col("track_genre")))
    return named.join(tracks.select("track_id"), "track_id", "left_semi").select("track_id", "track_genre").distinct()


def track_artists(tracks: DataFrame) -> DataFrame:
    """(track_id, artist_name, artist_name_norm, artist_order): artists between semicolons, numbered from 1."""
    split = tracks.select("track_id", F.posexplode(F.split("artists", ";")).alias("pos", "name"))
    name = F.trim("name")
    rows = split.where(name != "").select("track_id", name.alias("artist_name"), normalized(F.col("name")).alias("artist_name_norm"), (F.col("pos") + 1).cast("long").alias("artist_order"))
    return rows.distinct()


def clean_users(raw: DataFrame) -> DataFrame:
    """One row a user, the one with most scrobbles, of equals the least country; negative or null totals go."""
    best = Window.partitionBy("user_id").orderBy(F.desc("total_scrobbles"), F.asc_nulls_last("country"))
    rows = raw.where("user_id is not null and total_scrobbles >= 0")
    rows = rows.select("user_id", F.nullif(F.trim("country"), F.lit("")).alias("country"), "total_scrobbles")
    return rows.withColumn("choice", F.row_number().over(best)).where("choice = 1").drop("choice")


def _listening_reason(raw: DataFrame, users: DataFrame) -> DataFrame:
    known = users.select("user_id", F.lit(True).alias("known")).distinct()
    rules = [
        ("missing_user_id", F.col("user_id").isNull()),
        ("missing_track_name", blank(F.col("track_name"))),
        ("missing_artist_name", blank(F.col("artist_name"))),
        ("invalid_playcount", F.col("playcount").isNull() | (F.col("playcount") <= 0)),
        ("invalid_rank", F.col("rank").isNull() | (F.col("rank") <= 0)),
        ("unknown_user", F.col("known").isNull()),
    ]
    return raw.join(known, "user_id", "left").withColumn("rejection_reason", first_reason(rules)).drop("known")


def rejected_listening(raw: DataFrame, users: DataFrame) -> DataFrame:
    return _listening_reason(raw, users).where("rejection_reason is not null")


def clean_listening(raw: DataFrame, users: DataFrame) -> DataFrame:
    """One row a user, normalised title and artist: spelling and mbid of the most played row.

    Equal play counts are settled by the least rank, then the least text.
    """
    rows = _listening_reason(raw, users).where("rejection_reason is null")
    rows = rows.withColumns({
        "track_name": F.trim("track_name"), "artist_name": F.trim("artist_name"), "mbid": F.nullif(F.trim("mbid"), F.lit("")),
        "track_name_norm": normalized(F.col("track_name")), "artist_name_norm": normalized(F.col("artist_name")),
    })
    by, then = F.col("playcount"), F.col("rank")
    return rows.groupBy("user_id", "track_name_norm", "artist_name_norm").agg(
        value_at_max(F.col("track_name"), by, then).alias("track_name"),
        value_at_max(F.col("artist_name"), by, then).alias("artist_name"),
        F.max("playcount").alias("playcount"),
        F.min("rank").alias("source_rank"),
        value_at_max(F.col("mbid"), by, then).alias("mbid"),
        F.count("*").alias("merged_source_rows"),
    )


def listening_keys(listening: DataFrame) -> DataFrame:
    """One row a normalised title and artist, so that matching works on distinct keys."""
    by, then = F.col("playcount"), F.col("source_rank")
    return listening.groupBy("track_name_norm", "artist_name_norm").agg(
        value_at_max(F.col("track_name"), by, then).alias("representative_track_name"),
        value_at_max(F.col("artist_name"), by, then).alias("representative_artist_name"),
        F.count("*").alias("interaction_count"),
        F.count_distinct("user_id").alias("user_count"),
        F.sum("playcount").alias("total_playcount"),
    )


def quality_summary(counts: dict[str, DataFrame]) -> DataFrame:
    """(metric, metric_value): rows of each named frame, one scan each."""
    parts = [df.agg(F.lit(name).alias("metric"), F.count("*").alias("metric_value")) for name, df in counts.items()]
    return reduce(DataFrame.unionByName, parts)


def users_with_at_least(listening: DataFrame, levels: list[int]) -> DataFrame:
    """(metric, metric_value): users with as many tracks, for all levels in one pass."""
    per_user = listening.groupBy("user_id").agg(F.count("*").alias("n"))
    wide = per_user.agg(*[F.count_if(F.col("n") >= k).alias(f"users_with_{k}_plus_tracks") for k in levels])
    return wide.unpivot([], [f"users_with_{k}_plus_tracks" for k in levels], "metric", "metric_value")
