"""Exact entity matching and acoustic fingerprint clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.text import blank


def match_candidates(keys: DataFrame, tracks: DataFrame, artists: DataFrame) -> DataFrame:
    """Distinct (title, artist, spotify_track_id) with equal normalised title and any one equal artist."""
    full = keys.where(~blank(F.col("track_name_norm")) & ~blank(F.col("artist_name_norm"))).select("track_name_norm", "artist_name_norm")
    named = tracks.select("track_id", "track_name_norm").join(artists.select("track_id", "artist_name_norm"), "track_id")
    found = full.join(named, ["track_name_norm", "artist_name_norm"]).select("track_name_norm", "artist_name_norm", F.col("track_id").alias("spotify_track_id")).distinct()
    return found.withColumns({"match_tier": F.lit("tier_a_exact"), "title_similarity": F.lit(1.0), "artist_similarity": F.lit(1.0)})


def decide(keys: DataFrame, candidates: DataFrame, entity: str) -> DataFrame:
    """A decision for every key: one candidate is accepted, none rejected, several are ambiguous."""
    by = ["track_name_norm", "artist_name_norm"]
    found = candidates.groupBy(*by).agg(F.count_distinct(entity).alias("n"), F.min(entity).alias("only"))
    n = F.coalesce("n", F.lit(0))
    decision = F.when(n == 1, "accepted").when(n == 0, "rejected").otherwise("ambiguous")
    reason = F.when(n == 1, "single exact candidate").when(n == 0, "no exact candidate").otherwise("several exact candidates")
    return keys.select(*by).join(found, by, "left").select(*by, n.cast("long").alias("candidate_count"), decision.alias("decision"), F.when(n == 1, F.col("only")).alias("accepted_id"), reason.alias("decision_reason"))


def crosswalk(decisions: DataFrame) -> DataFrame:
    return decisions.where("decision = 'accepted'").select("track_name_norm", "artist_name_norm", "accepted_id")


def integrated_interactions(listening: DataFrame, cross: DataFrame, entity: str) -> DataFrame:
    """One row a user and matched entity: highest play count, log confidence, best rank, keys merged."""
    joined = listening.join(cross, ["track_name_norm", "artist_name_norm"]).withColumnRenamed("accepted_id", entity)
    return joined.groupBy("user_id", entity).agg(
        F.max("playcount").alias("playcount_raw"),
        F.lit(1).cast("long").alias("preference"),
        (1 + F.log(1 + F.max("playcount"))).alias("confidence_log"),
        F.min("source_rank").alias("source_rank"),
        F.count_distinct(F.struct("track_name_norm", "artist_name_norm")).alias("merged_listening_key_count"),
    )


def fingerprint_members(tracks: DataFrame, artists: DataFrame, fields: list[str]) -> DataFrame:
    """Tracks with the id of their cluster: SHA-256 of normalised title, first artist and ``fields``.

    Doubles enter as decimals of fifteen places, more than the audio columns have, so text
    forms don't matter; null is its own value. The canonical member is the most popular, then the least id.
    """
    first = artists.where("artist_order = 1").groupBy("track_id").agg(F.min("artist_name_norm").alias("primary_artist_norm"))
    rows = tracks.join(first, "track_id", "left").withColumn("primary_artist_norm", F.coalesce("primary_artist_norm", F.lit("")))
    types = dict(tracks.dtypes)
    texts = [F.col(f).cast("decimal(30,15)").cast("string") if types[f] in ("double", "float") else F.col(f).cast("string") for f in fields]
    mark = F.concat_ws("|", F.col("track_name_norm"), F.col("primary_artist_norm"), *[F.coalesce(t, F.lit("~")) for t in texts])
    rows = rows.withColumn("feature_cluster_id", F.sha2(mark, 256))
    by = Window.partitionBy("feature_cluster_id")
    order = by.orderBy(F.desc_nulls_last("popularity"), "track_id")
    return rows.withColumn("member_rank", F.row_number().over(order)).withColumn("member_count", F.count("*").over(by))


def clusters(members: DataFrame) -> DataFrame:
    """The canonical member of each cluster, with its size."""
    top = members.where("member_rank = 1").drop("member_rank")
    return top.withColumnRenamed("track_id", "canonical_track_id").withColumnRenamed("popularity", "canonical_popularity")


def cluster_candidates(candidates: DataFrame, members: DataFrame) -> DataFrame:
    """Track candidates lifted to clusters, each key and cluster once, with the number of its tracks that fit."""
    own = members.select(F.col("track_id").alias("spotify_track_id"), "feature_cluster_id")
    return candidates.join(own, "spotify_track_id").groupBy("track_name_norm", "artist_name_norm", "feature_cluster_id").agg(F.count_distinct("spotify_track_id").alias("spotify_id_count"))


def review_sample(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """``n`` rows in the order of a hash of ``by``, with blank columns for a reviewer."""
    mark = F.sha2(F.concat_ws(":", *[F.col(c) for c in by]), 256)
    picked = rows.withColumn("sample_hash", mark).orderBy("sample_hash", *by).limit(n)
    return picked.withColumns({"review_decision": F.lit(""), "review_notes": F.lit("")})


def joined_names(artists: DataFrame) -> DataFrame:
    """(track_id, artist_names): distinct names in order, joined by semicolons."""
    return artists.groupBy("track_id").agg(F.array_join(F.sort_array(F.collect_set("artist_name")), "; ").alias("artist_names"))


def _sampled_keys(decisions: DataFrame, n: int) -> DataFrame:
    """``n`` ambiguous keys with their decision columns, in the order of a hash of the key."""
    by = ["track_name_norm", "artist_name_norm"]
    return decisions.where("decision = 'ambiguous'").orderBy(F.sha2(F.concat_ws(":", *by), 256), *by).limit(n)


def ambiguous_review(decisions: DataFrame, candidates: DataFrame, keys: DataFrame, tracks: DataFrame, genres: DataFrame, n: int = 100) -> DataFrame:
    """All candidates of ``n`` ambiguous keys with their tracks and genres, ordered for a reviewer."""
    by = ["track_name_norm", "artist_name_norm"]
    lists = genres.groupBy("track_id").agg(F.array_join(F.sort_array(F.collect_set("track_genre")), "; ").alias("spotify_genres"))
    rows = _sampled_keys(decisions, n).select(*by, "candidate_count").join(candidates.select(*by, "spotify_track_id", "match_tier"), by)
    rows = rows.join(keys.select(*by, "representative_track_name", "representative_artist_name"), by)
    rows = rows.join(tracks, F.col("spotify_track_id") == F.col("track_id")).join(lists, "track_id", "left")
    ordered = rows.orderBy("representative_track_name", "representative_artist_name", F.desc_nulls_last("popularity"), "spotify_track_id")
    return ordered.select(
        F.col("representative_track_name").alias("listening_track"), F.col("representative_artist_name").alias("listening_artist"), "spotify_track_id",
        F.col("track_name").alias("spotify_track"), F.col("artists").alias("spotify_artists"), F.col("album_name").alias("spotify_album"), "spotify_genres",
        "duration_ms", "popularity", "candidate_count", "match_tier", *[F.lit("").alias(c) for c in ("review_action", "selected_spotify_track_id", "review_reason", "reviewer")],
    )


def cluster_review(decisions: DataFrame, lifted: DataFrame, keys: DataFrame, tracks: DataFrame, members: DataFrame, n: int = 100) -> DataFrame:
    """All candidate clusters of ``n`` ambiguous keys with their canonical track and the members' albums, ordered for a reviewer."""
    by = ["track_name_norm", "artist_name_norm"]
    albums = members.groupBy("feature_cluster_id").agg(F.array_join(F.sort_array(F.collect_set("album_name")), "; ").alias("member_albums"))
    canonical = clusters(members).select("feature_cluster_id", "canonical_track_id", "canonical_popularity")
    names = tracks.select(F.col("track_id").alias("canonical_track_id"), F.col("track_name").alias("canonical_spotify_track"), F.col("artists").alias("canonical_spotify_artists"), "duration_ms")
    rows = _sampled_keys(decisions, n).select(*by, "candidate_count").join(lifted, by).join(keys.select(*by, "representative_track_name", "representative_artist_name"), by)
    rows = rows.join(canonical, "feature_cluster_id").join(names, "canonical_track_id").join(albums, "feature_cluster_id", "left")
    ordered = rows.orderBy("representative_track_name", "representative_artist_name", F.desc_nulls_last("canonical_popularity"), "feature_cluster_id")
    return ordered.select(
        F.col("representative_track_name").alias("listening_track"), F.col("representative_artist_name").alias("listening_artist"), F.col("candidate_count").alias("feature_cluster_count"),
        "feature_cluster_id", F.col("spotify_id_count").alias("ids_in_this_cluster"), "canonical_track_id", "canonical_spotify_track", "canonical_spotify_artists", "member_albums",
        "duration_ms", "canonical_popularity", *[F.lit("").alias(c) for c in ("review_action", "selected_feature_cluster_id", "review_reason", "reviewer")],
    )


def integration_audit(run_id: str, keys: DataFrame, candidates: DataFrame, decisions: DataFrame, interactions: DataFrame, entity: str) -> DataFrame:
    """(run_id, metric, value, recorded_at) of a matching run, one pass over each frame."""
    decided = decisions.agg(*[F.count_if(F.col("decision") == d).alias(n) for d, n in (("accepted", "accepted_keys"), ("ambiguous", "ambiguous_keys"), ("rejected", "unmatched_keys"))])
    own = interactions.agg(
        F.count("*").alias("integrated_interactions"), F.count_distinct("user_id").alias("integrated_users"), F.count_distinct(entity).alias("integrated_items"),
        F.count_if(F.col("merged_listening_key_count") > 1).alias("interactions_merging_several_keys"),
    )
    per_user = interactions.groupBy("user_id").agg(F.count("*").alias("n")).agg(*[F.count_if(F.col("n") >= k).alias(f"users_with_{k}_plus") for k in (5, 10, 20)])
    wide = keys.agg(F.count("*").alias("listening_keys")).crossJoin(candidates.agg(F.count("*").alias("candidate_rows"))).crossJoin(decided).crossJoin(own).crossJoin(per_user)  # one row each
    long = wide.select(*[F.col(c).cast("double").alias(c) for c in wide.columns]).unpivot([], wide.columns, "metric", "value")
    return long.select(F.lit(run_id).alias("run_id"), "metric", "value", F.current_timestamp().alias("recorded_at"))
