"""Queries over the supplied tables, one for each operator, and the same in SQL.

Doubles are rounded to six places after ranking, counts are longs, and every order is
total, so that results can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.text import ascii_normalized
from cadenza.operators import cleaning as C
from cadenza.operators import constraints as K
from cadenza.operators import features as X
from cadenza.operators import graph as G
from cadenza.operators import matching as A
from cadenza.operators import metrics as E
from cadenza.operators import models as M
from cadenza.operators import splits as S
from cadenza.operators.factorization import ImplicitALS, recommend_sgd
from cadenza.plans import fixtures as fx
from cadenza.plans import layout as L
from cadenza.plans.experiment import experiment_violations
from cadenza.plans.runners import run_grid
from cadenza.session import checkpointed, free_shuffles, stored
from cadenza.streaming.popularity import windowed_popularity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Feature columns of the supplied catalog.
CONTINUOUS, KEYS = ["size", "price"], list(range(12))
NEIGHBOURS, TOP = 50, 10


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles rounded to six places; -0.0 becomes 0.0."""
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})


# Frames that several queries start from


def _raw_tracks(spark, sf):
    return C.stage_tracks(fx.fixture(spark, sf, fx.RAW_TRACKS))


def _tracks(spark, sf):
    return C.canonical_tracks(_raw_tracks(spark, sf))


def _listening(spark, sf):
    users = C.clean_users(fx.fixture(spark, sf, fx.RAW_USERS))
    return C.clean_listening(fx.fixture(spark, sf, fx.RAW_LISTENING), users)


def _candidates(spark, sf):
    tracks = _tracks(spark, sf)
    return A.match_candidates(C.listening_keys(_listening(spark, sf)), tracks, C.track_artists(tracks))


def _interactions(spark, sf):
    return fx.fixture(spark, sf, fx.INTERACTIONS)


def _split(spark, sf):
    return S.three_way_split(_interactions(spark, sf))


def _train(spark, sf):
    return _split(spark, sf).where("split = 'train'").drop("split")


def _truth(spark, sf):
    return _split(spark, sf).where("split = 'validation'").select("user_id", "item_id")


def _vectors(spark, sf):
    return fx.fixture(spark, sf, fx.VECTORS).select("item_id", F.col("features").cast("array<double>").alias("features"))


# The same in SQL

NORM = r"lower(trim(regexp_replace({}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')))"
NORM_ARTISTS = r"lower(trim(regexp_replace({}, '[^\p{{L}}\p{{N}};]+', ' ', 'g')))"

SQL_STAGED = f"""staged AS (SELECT source_row_id, trim(track_id) AS track_id, trim(artists) AS artists, trim(album_name) AS album_name, trim(track_name) AS track_name,
  popularity, duration_ms, explicit, danceability, energy, key, loudness, mode, speechiness, acousticness, instrumentalness, liveness, valence, tempo, time_signature, trim(track_genre) AS track_genre
  FROM ({fx.RAW_TRACKS}))"""
SQL_ACCEPTED = SQL_STAGED + ", accepted AS (SELECT * FROM staged WHERE coalesce(track_id, '') <> '' AND coalesce(track_name, '') <> '' AND coalesce(artists, '') <> '')"
SQL_TRACKS = SQL_ACCEPTED + f""", tracks AS (SELECT * EXCLUDE (tempo), CASE WHEN tempo > 0 THEN tempo END AS tempo, {NORM.format('track_name')} AS track_name_norm, {NORM_ARTISTS.format('artists')} AS artists_norm
  FROM accepted QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY popularity DESC NULLS LAST, track_genre NULLS LAST, source_row_id NULLS LAST) = 1)"""
SQL_ARTISTS = SQL_TRACKS + f""", artists AS (SELECT DISTINCT track_id, trim(a) AS artist_name, {NORM.format('a')} AS artist_name_norm, o::BIGINT AS artist_order
  FROM (SELECT track_id, unnest(string_split(artists, ';')) AS a, generate_subscripts(string_split(artists, ';'), 1) AS o FROM tracks) WHERE trim(a) <> '')"""
SQL_USERS = f"""users AS (SELECT user_id, nullif(trim(country), '') AS country, total_scrobbles FROM ({fx.RAW_USERS}) WHERE user_id IS NOT NULL AND total_scrobbles >= 0
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY total_scrobbles DESC, country NULLS LAST) = 1)"""
SQL_LISTENED = SQL_USERS + f""", judged AS (SELECT r.*, CASE WHEN r.user_id IS NULL THEN 'missing_user_id' WHEN coalesce(trim(track_name), '') = '' THEN 'missing_track_name'
  WHEN coalesce(trim(artist_name), '') = '' THEN 'missing_artist_name' WHEN playcount IS NULL OR playcount <= 0 THEN 'invalid_playcount' WHEN rank IS NULL OR rank <= 0 THEN 'invalid_rank'
  WHEN r.user_id NOT IN (SELECT user_id FROM users) THEN 'unknown_user' END AS rejection_reason FROM ({fx.RAW_LISTENING}) r)"""


def _first(value: str, by: str, then: str) -> str:
    return f"(list({value} ORDER BY {by} DESC, {then}, {value}) FILTER (WHERE {value} IS NOT NULL))[1]"


SQL_LISTENING = SQL_LISTENED + f""", cleaned AS (SELECT user_id, rank, trim(track_name) AS track_name, trim(artist_name) AS artist_name, {NORM.format('track_name')} AS track_name_norm,
  {NORM.format('artist_name')} AS artist_name_norm, playcount, nullif(trim(mbid), '') AS mbid FROM judged WHERE rejection_reason IS NULL),
listening AS (SELECT user_id, track_name_norm, artist_name_norm, {_first('track_name', 'playcount', 'rank')} AS track_name, {_first('artist_name', 'playcount', 'rank')} AS artist_name,
  max(playcount) AS playcount, min(rank) AS source_rank, {_first('mbid', 'playcount', 'rank')} AS mbid, count(*) AS merged_source_rows FROM cleaned GROUP BY user_id, track_name_norm, artist_name_norm)"""
SQL_KEYS = SQL_LISTENING + f""", keys AS (SELECT track_name_norm, artist_name_norm, {_first('track_name', 'playcount', 'source_rank')} AS representative_track_name,
  {_first('artist_name', 'playcount', 'source_rank')} AS representative_artist_name, count(*) AS interaction_count, count(DISTINCT user_id) AS user_count, sum(playcount)::BIGINT AS total_playcount
  FROM listening GROUP BY track_name_norm, artist_name_norm)"""
SQL_CANDIDATES = SQL_KEYS + ", " + SQL_ARTISTS + """, candidates AS (SELECT DISTINCT k.track_name_norm, k.artist_name_norm, t.track_id AS spotify_track_id FROM keys k JOIN tracks t USING (track_name_norm)
  JOIN artists a ON a.track_id = t.track_id AND a.artist_name_norm = k.artist_name_norm WHERE k.track_name_norm <> '' AND k.artist_name_norm <> '')"""
SQL_DECISIONS = SQL_CANDIDATES + """, decisions AS (SELECT k.track_name_norm, k.artist_name_norm, count(DISTINCT spotify_track_id) AS candidate_count,
  CASE count(DISTINCT spotify_track_id) WHEN 1 THEN 'accepted' WHEN 0 THEN 'rejected' ELSE 'ambiguous' END AS decision,
  CASE WHEN count(DISTINCT spotify_track_id) = 1 THEN min(spotify_track_id) END AS accepted_id,
  CASE count(DISTINCT spotify_track_id) WHEN 1 THEN 'single exact candidate' WHEN 0 THEN 'no exact candidate' ELSE 'several exact candidates' END AS decision_reason
  FROM keys k LEFT JOIN candidates c ON k.track_name_norm = c.track_name_norm AND k.artist_name_norm = c.artist_name_norm GROUP BY k.track_name_norm, k.artist_name_norm)"""
FINGERPRINT = ["duration_ms", "explicit", *C.VECTOR_COLUMNS[1:]]
_DOUBLES = {"danceability", "energy", "loudness", "speechiness", "acousticness", "instrumentalness", "liveness", "valence", "tempo"}
SQL_MEMBERS = SQL_ARTISTS + """, marked AS (SELECT t.*, coalesce(p.artist_name_norm, '') AS primary_artist_norm FROM tracks t
  LEFT JOIN (SELECT track_id, min(artist_name_norm) AS artist_name_norm FROM artists WHERE artist_order = 1 GROUP BY track_id) p USING (track_id)),
members AS (SELECT *, count(*) OVER (PARTITION BY feature_cluster_id) AS member_count, row_number() OVER (PARTITION BY feature_cluster_id ORDER BY popularity DESC NULLS LAST, track_id) AS member_rank
  FROM (SELECT *, sha256(concat_ws('|', track_name_norm, primary_artist_norm, %s)) AS feature_cluster_id FROM marked))""" % ", ".join(
    f"coalesce({f'CAST({c} AS DECIMAL(30,15))' if c in _DOUBLES else c}::VARCHAR, '~')" for c in FINGERPRINT
)
SQL_INTERACTIONS = f"inter AS ({fx.INTERACTIONS})"
SQL_SPLIT = SQL_INTERACTIONS + """, sized AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY sha256(concat_ws(':', 42, user_id, item_id)), item_id) AS place FROM inter),
assigned AS (SELECT user_id, item_id, play_count, CASE WHEN n < 20 THEN 'train' WHEN place <= greatest(1, floor(n * 0.1)) THEN 'validation' WHEN place <= 2 * greatest(1, floor(n * 0.1)) THEN 'test' ELSE 'train' END AS split FROM sized),
train AS (SELECT user_id, item_id, play_count FROM assigned WHERE split = 'train'), truth AS (SELECT user_id, item_id FROM assigned WHERE split = 'validation'),
conf AS (SELECT user_id, item_id, 1 + ln(1 + greatest(0.0, play_count)) AS c FROM train)"""
SQL_BM25 = """, lens AS (SELECT user_id, sum(c) AS len FROM conf GROUP BY user_id), whole AS (SELECT count(*) AS u, avg(len) AS mean FROM lens), df AS (SELECT item_id, count(*) AS df FROM conf GROUP BY item_id),
bm AS (SELECT user_id, item_id, ln(1 + u / (1 + df)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len / mean)) AS c FROM conf JOIN lens USING (user_id) JOIN df USING (item_id), whole)"""


def _sql_knn(weights: str, least: int = 2, n: int = NEIGHBOURS) -> str:
    return f""", nrm AS (SELECT item_id, sqrt(sum(c * c)) AS nn FROM {weights} GROUP BY item_id), unit AS (SELECT user_id, item_id, c / nn AS x FROM {weights} JOIN nrm USING (item_id)),
sims AS (SELECT a.item_id, b.item_id AS other_id, sum(a.x * b.x) AS similarity FROM unit a JOIN unit b ON a.user_id = b.user_id AND a.item_id <> b.item_id GROUP BY ALL HAVING count(*) >= {least}),
knn AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(similarity, 9) DESC, other_id) AS rank FROM sims QUALIFY rank <= {n})"""


SQL_CF = """, cf AS (SELECT user_id, other_id AS item_id, sum(c * similarity) AS score FROM conf JOIN knn USING (item_id) GROUP BY user_id, other_id)"""


def _sql_top(scores: str, k: int = TOP, where: str = "TRUE") -> str:
    return f"""recs AS (SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank
  FROM {scores} s WHERE {where} AND NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = s.user_id AND t.item_id = s.item_id) QUALIFY rank <= {k})"""


SQL_RECS = "SELECT user_id, item_id, rank, round(score, 6) + 0.0 AS score FROM recs"
SQL_VEC = f", vec AS (SELECT item_id, list_transform(features, lambda x: x::DOUBLE) AS f FROM ({fx.VECTORS}))"
SQL_CONTENT = SQL_VEC + """, own AS (SELECT conf.*, f FROM conf JOIN vec USING (item_id)), dims AS (SELECT user_id, d, sum(c * f[d]) / sum(c) AS x FROM own, range(1, 65) r(d) GROUP BY user_id, d),
profiles AS (SELECT user_id, list(x ORDER BY d) AS p FROM dims GROUP BY user_id), content AS (SELECT user_id, item_id, list_cosine_similarity(p, f) AS score FROM profiles, vec)"""


# Cleaning


@query(f"WITH {SQL_STAGED} SELECT source_row_id, CASE WHEN coalesce(track_id, '') = '' THEN 'missing_track_id' WHEN coalesce(track_name, '') = '' THEN 'missing_track_name' ELSE 'missing_artists' END AS rejection_reason FROM staged WHERE coalesce(track_id, '') = '' OR coalesce(track_name, '') = '' OR coalesce(artists, '') = ''")
def rejected_rows(spark, sf):
    return C.rejected_tracks(_raw_tracks(spark, sf)).select("source_row_id", "rejection_reason")


_UNIT = " OR ".join(f"{c} NOT BETWEEN 0 AND 1" for c in C.UNIT_COLUMNS)


@query(f"""WITH {SQL_STAGED}, r AS (SELECT source_row_id, track_id, CASE WHEN popularity NOT BETWEEN 0 AND 100 THEN 'invalid_popularity' WHEN duration_ms <= 0 THEN 'invalid_duration' WHEN {_UNIT} THEN 'invalid_unit_feature'
  WHEN key NOT BETWEEN -1 AND 11 THEN 'invalid_key' WHEN mode NOT IN (0, 1) THEN 'invalid_mode' WHEN tempo <= 0 THEN 'missing_or_invalid_tempo' WHEN time_signature <= 0 THEN 'invalid_time_signature' END AS issue_reason FROM staged)
SELECT * FROM r WHERE issue_reason IS NOT NULL""")
def range_issues(spark, sf):
    return C.feature_issues(_raw_tracks(spark, sf))


@query(f"""WITH {SQL_ACCEPTED} SELECT track_id, count(*) AS source_rows, count(DISTINCT track_name) AS distinct_titles, count(DISTINCT artists) AS distinct_artist_strings, count(DISTINCT track_genre) AS distinct_genres,
  count(DISTINCT struct_pack({', '.join(f'{c} := {c}' for c in C.VECTOR_COLUMNS)})) AS distinct_feature_vectors FROM accepted GROUP BY track_id HAVING count(*) > 1""")
def duplicate_audit(spark, sf):
    return C.duplicate_audit(_raw_tracks(spark, sf))


@query(f"WITH {SQL_TRACKS} SELECT track_id, track_name, track_name_norm, artists_norm, popularity, round(tempo, 6) AS tempo, key, explicit FROM tracks")
def canonical_row(spark, sf):
    return _tracks(spark, sf).select("track_id", "track_name", "track_name_norm", "artists_norm", "popularity", F.round("tempo", 6).alias("tempo"), "key", "explicit")


@query(f"WITH {SQL_ARTISTS} SELECT * FROM artists")
def artist_bridge(spark, sf):
    return C.track_artists(_tracks(spark, sf))


@query(f"WITH {SQL_TRACKS} SELECT DISTINCT s.track_id, s.track_genre FROM staged s JOIN tracks t USING (track_id) WHERE s.track_genre IS NOT NULL AND s.track_genre <> ''")
def genre_bridge(spark, sf):
    return C.track_genres(_raw_tracks(spark, sf), _tracks(spark, sf))


@query(f"WITH {SQL_USERS} SELECT * FROM users")
def clean_users(spark, sf):
    return C.clean_users(fx.fixture(spark, sf, fx.RAW_USERS))


@query(f"WITH {SQL_LISTENED} SELECT rejection_reason, count(*) AS n FROM judged WHERE rejection_reason IS NOT NULL GROUP BY rejection_reason")
def rejected_listening(spark, sf):
    users = C.clean_users(fx.fixture(spark, sf, fx.RAW_USERS))
    return C.rejected_listening(fx.fixture(spark, sf, fx.RAW_LISTENING), users).groupBy("rejection_reason").agg(F.count("*").alias("n"))


@query(f"WITH {SQL_LISTENING} SELECT * FROM listening")
def clean_listening(spark, sf):
    return _listening(spark, sf)


@query(f"WITH {SQL_KEYS} SELECT * FROM keys")
def track_keys(spark, sf):
    return C.listening_keys(_listening(spark, sf))


@query(f"""WITH {SQL_KEYS}, per AS (SELECT user_id, count(*) AS n FROM listening GROUP BY user_id)
SELECT 'clean_users' AS metric, count(*) AS metric_value FROM users UNION ALL SELECT 'clean_track_interactions', count(*) FROM listening UNION ALL SELECT 'rejected_track_rows', count(*) FROM judged WHERE rejection_reason IS NOT NULL
UNION ALL SELECT 'distinct_listening_track_keys', count(*) FROM keys UNION ALL SELECT 'users_with_5_plus_tracks', count(*) FROM per WHERE n >= 5 UNION ALL SELECT 'users_with_10_plus_tracks', count(*) FROM per WHERE n >= 10
UNION ALL SELECT 'users_with_20_plus_tracks', count(*) FROM per WHERE n >= 20""")
def quality_summary(spark, sf):
    users = C.clean_users(fx.fixture(spark, sf, fx.RAW_USERS))
    raw = fx.fixture(spark, sf, fx.RAW_LISTENING)
    listening = checkpointed(C.clean_listening(raw, users))
    counts = C.quality_summary({"clean_users": users, "clean_track_interactions": listening, "rejected_track_rows": C.rejected_listening(raw, users), "distinct_listening_track_keys": C.listening_keys(listening)})
    return counts.unionByName(C.users_with_at_least(listening, [5, 10, 20]))


# Matching


@query(f"WITH {SQL_CANDIDATES} SELECT *, 'tier_a_exact' AS match_tier, 1.0::DOUBLE AS title_similarity, 1.0::DOUBLE AS artist_similarity FROM candidates")
def match_candidates(spark, sf):
    return _candidates(spark, sf)


@query(f"WITH {SQL_DECISIONS} SELECT * FROM decisions")
def match_decisions(spark, sf):
    return A.decide(C.listening_keys(_listening(spark, sf)), _candidates(spark, sf), "spotify_track_id")


@query(f"WITH {SQL_DECISIONS} SELECT track_name_norm, artist_name_norm, accepted_id FROM decisions WHERE decision = 'accepted'")
def crosswalk(spark, sf):
    return A.crosswalk(match_decisions(spark, sf))


@query(f"""WITH {SQL_DECISIONS} SELECT user_id, accepted_id AS spotify_track_id, max(playcount) AS playcount_raw, 1::BIGINT AS preference, round(1 + ln(1 + max(playcount)), 6) AS confidence_log, min(source_rank) AS source_rank,
  count(DISTINCT struct_pack(a := track_name_norm, b := artist_name_norm)) AS merged_listening_key_count FROM listening JOIN decisions USING (track_name_norm, artist_name_norm) WHERE decision = 'accepted' GROUP BY user_id, accepted_id""")
def integrated_interactions(spark, sf):
    return rounded(A.integrated_interactions(_listening(spark, sf), crosswalk(spark, sf), "spotify_track_id"), "confidence_log")


@query(f"WITH {SQL_MEMBERS} SELECT feature_cluster_id, track_id AS canonical_track_id, popularity AS canonical_popularity, track_name_norm, primary_artist_norm, member_count FROM members WHERE member_rank = 1")
def fingerprint_clusters(spark, sf):
    tracks = _tracks(spark, sf)
    members = A.fingerprint_members(tracks, C.track_artists(tracks), FINGERPRINT)
    return A.clusters(members).select("feature_cluster_id", "canonical_track_id", "canonical_popularity", "track_name_norm", "primary_artist_norm", "member_count")


@query(f"WITH {SQL_MEMBERS} SELECT feature_cluster_id, track_id, album_name, popularity, member_rank = 1 AS is_canonical FROM members")
def cluster_members(spark, sf):
    tracks = _tracks(spark, sf)
    members = A.fingerprint_members(tracks, C.track_artists(tracks), FINGERPRINT)
    return members.select("feature_cluster_id", "track_id", "album_name", "popularity", (F.col("member_rank") == 1).alias("is_canonical"))


@query(f"""WITH {SQL_CANDIDATES}, {SQL_MEMBERS.replace(SQL_ARTISTS + ', ', '', 1)}, lifted AS (SELECT DISTINCT track_name_norm, artist_name_norm, feature_cluster_id FROM candidates JOIN (SELECT track_id AS spotify_track_id, feature_cluster_id FROM members) USING (spotify_track_id))
SELECT decision, count(*) AS n FROM (SELECT k.track_name_norm, CASE count(DISTINCT feature_cluster_id) WHEN 1 THEN 'accepted' WHEN 0 THEN 'rejected' ELSE 'ambiguous' END AS decision
FROM keys k LEFT JOIN lifted l ON k.track_name_norm = l.track_name_norm AND k.artist_name_norm = l.artist_name_norm GROUP BY k.track_name_norm, k.artist_name_norm) GROUP BY decision""")
def cluster_decisions(spark, sf):
    tracks = _tracks(spark, sf)
    members = A.fingerprint_members(tracks, C.track_artists(tracks), FINGERPRINT)
    lifted = A.cluster_candidates(_candidates(spark, sf), members)
    return A.decide(C.listening_keys(_listening(spark, sf)), lifted, "feature_cluster_id").groupBy("decision").agg(F.count("*").alias("n"))


@query(f"""WITH {SQL_CANDIDATES} SELECT c.track_name_norm, c.artist_name_norm, spotify_track_id, artist_names, sha256(concat_ws(':', c.track_name_norm, c.artist_name_norm, spotify_track_id)) AS sample_hash, '' AS review_decision, '' AS review_notes
FROM candidates c JOIN (SELECT track_id AS spotify_track_id, string_agg(DISTINCT artist_name, '; ' ORDER BY artist_name) AS artist_names FROM artists GROUP BY track_id) USING (spotify_track_id) ORDER BY sample_hash, 1, 2, 3 LIMIT 100""")
def review_sample(spark, sf):
    names = A.joined_names(C.track_artists(_tracks(spark, sf))).withColumnRenamed("track_id", "spotify_track_id")
    rows = _candidates(spark, sf).select("track_name_norm", "artist_name_norm", "spotify_track_id").join(names, "spotify_track_id")
    return A.review_sample(rows, 100, "track_name_norm", "artist_name_norm", "spotify_track_id")


@query(f"WITH {SQL_TRACKS} SELECT t.track_id, t.popularity, list(g.track_genre ORDER BY g.track_genre) FILTER (WHERE g.track_genre IS NOT NULL) AS genres FROM tracks t LEFT JOIN (SELECT DISTINCT track_id, track_genre FROM staged WHERE track_genre <> '') g USING (track_id) GROUP BY ALL ORDER BY t.popularity DESC, t.track_id LIMIT 50")
def list_genres_example(spark, sf):
    tracks, genres = _tracks(spark, sf), genre_bridge(spark, sf)
    lists = genres.groupBy("track_id").agg(F.sort_array(F.collect_list("track_genre")).alias("genres"))
    return tracks.select("track_id", "popularity").join(lists, "track_id", "left").select("track_id", "popularity", "genres").orderBy(F.desc("popularity"), "track_id").limit(50)


SQL_CLUSTERED = SQL_DECISIONS + ", " + SQL_MEMBERS.replace(SQL_ARTISTS + ", ", "", 1) + """, lifted AS (SELECT track_name_norm, artist_name_norm, feature_cluster_id, count(DISTINCT spotify_track_id) AS spotify_id_count FROM candidates JOIN (SELECT track_id AS spotify_track_id, feature_cluster_id FROM members) USING (spotify_track_id) GROUP BY ALL),
cdecisions AS (SELECT k.track_name_norm, k.artist_name_norm, count(feature_cluster_id) AS candidate_count, CASE count(feature_cluster_id) WHEN 1 THEN 'accepted' WHEN 0 THEN 'rejected' ELSE 'ambiguous' END AS decision, CASE WHEN count(feature_cluster_id) = 1 THEN min(feature_cluster_id) END AS accepted_id
  FROM keys k LEFT JOIN lifted l ON k.track_name_norm = l.track_name_norm AND k.artist_name_norm = l.artist_name_norm GROUP BY ALL),
cinter AS (SELECT user_id, accepted_id AS feature_cluster_id, max(playcount) AS playcount_raw, 1::BIGINT AS preference, round(1 + ln(1 + max(playcount)), 6) AS confidence_log, min(source_rank) AS source_rank,
  count(DISTINCT struct_pack(a := track_name_norm, b := artist_name_norm)) AS merged_listening_key_count FROM listening JOIN cdecisions USING (track_name_norm, artist_name_norm) WHERE decision = 'accepted' GROUP BY user_id, accepted_id)"""
_KEY_HASH = "sha256(concat_ws(':', track_name_norm, artist_name_norm)), track_name_norm, artist_name_norm"
_BLANK = ", ".join(f"'' AS {c}" for c in ("review_action", "review_reason", "reviewer"))


def _clustered(spark, sf):
    """(keys, candidates, tracks, members, lifted candidates, decisions) at the level of clusters; listening is cleaned once."""
    tracks = checkpointed(_tracks(spark, sf))
    listening = checkpointed(_listening(spark, sf))
    keys, artists = C.listening_keys(listening), C.track_artists(tracks)
    members = A.fingerprint_members(tracks, artists, FINGERPRINT)
    lifted = A.cluster_candidates(A.match_candidates(keys, tracks, artists), members)
    return listening, keys, tracks, members, lifted, A.decide(keys, lifted, "feature_cluster_id")


@query(f"WITH {SQL_CLUSTERED} SELECT track_name_norm, artist_name_norm, accepted_id, spotify_id_count FROM cdecisions d JOIN lifted l USING (track_name_norm, artist_name_norm) WHERE decision = 'accepted'")
def cluster_crosswalk(spark, sf):
    *_, lifted, decisions = _clustered(spark, sf)
    return A.crosswalk(decisions).join(lifted.drop("feature_cluster_id"), ["track_name_norm", "artist_name_norm"])


@query(f"WITH {SQL_CLUSTERED} SELECT * FROM cinter")
def cluster_interactions(spark, sf):
    listening, *_, decisions = _clustered(spark, sf)
    return rounded(A.integrated_interactions(listening, A.crosswalk(decisions), "feature_cluster_id"), "confidence_log")


@query(f"""WITH {SQL_DECISIONS}, picked AS (SELECT * FROM decisions WHERE decision = 'ambiguous' ORDER BY {_KEY_HASH} LIMIT 100)
SELECT k.representative_track_name AS listening_track, k.representative_artist_name AS listening_artist, c.spotify_track_id, t.track_name AS spotify_track, t.artists AS spotify_artists, t.album_name AS spotify_album,
  (SELECT string_agg(DISTINCT g.track_genre, '; ' ORDER BY g.track_genre) FROM staged g WHERE g.track_id = t.track_id AND g.track_genre <> '') AS spotify_genres, t.duration_ms, t.popularity, p.candidate_count, 'tier_a_exact' AS match_tier, {_BLANK}, '' AS selected_spotify_track_id
FROM picked p JOIN candidates c USING (track_name_norm, artist_name_norm) JOIN keys k USING (track_name_norm, artist_name_norm) JOIN tracks t ON t.track_id = c.spotify_track_id""")
def ambiguous_review(spark, sf):
    tracks = _tracks(spark, sf)
    keys = C.listening_keys(_listening(spark, sf))
    candidates = A.match_candidates(keys, tracks, C.track_artists(tracks))
    return A.ambiguous_review(A.decide(keys, candidates, "spotify_track_id"), candidates, keys, tracks, genre_bridge(spark, sf))


@query(f"""WITH {SQL_CLUSTERED}, picked AS (SELECT * FROM cdecisions WHERE decision = 'ambiguous' ORDER BY {_KEY_HASH} LIMIT 100)
SELECT k.representative_track_name AS listening_track, k.representative_artist_name AS listening_artist, p.candidate_count AS feature_cluster_count, feature_cluster_id, l.spotify_id_count AS ids_in_this_cluster, m.track_id AS canonical_track_id,
  m.track_name AS canonical_spotify_track, m.artists AS canonical_spotify_artists, (SELECT string_agg(DISTINCT a.album_name, '; ' ORDER BY a.album_name) FROM members a WHERE a.feature_cluster_id = m.feature_cluster_id) AS member_albums,
  m.duration_ms, m.popularity AS canonical_popularity, {_BLANK}, '' AS selected_feature_cluster_id
FROM picked p JOIN lifted l USING (track_name_norm, artist_name_norm) JOIN keys k USING (track_name_norm, artist_name_norm) JOIN (SELECT * FROM members WHERE member_rank = 1) m USING (feature_cluster_id)""")
def cluster_review(spark, sf):
    _, keys, tracks, members, lifted, decisions = _clustered(spark, sf)
    return A.cluster_review(decisions, lifted, keys, tracks, members)


def _sql_audit(run_id, candidates, decisions, inter, entity):
    counts = {"listening_keys": "count(*) FROM keys", "candidate_rows": f"count(*) FROM {candidates}", "integrated_interactions": f"count(*) FROM {inter}", "integrated_users": f"count(DISTINCT user_id) FROM {inter}", "integrated_items": f"count(DISTINCT {entity}) FROM {inter}", "interactions_merging_several_keys": f"count(*) FROM {inter} WHERE merged_listening_key_count > 1"}
    counts |= {n: f"count(*) FROM {decisions} WHERE decision = '{d}'" for n, d in (("accepted_keys", "accepted"), ("ambiguous_keys", "ambiguous"), ("unmatched_keys", "rejected"))}
    counts |= {f"users_with_{k}_plus": f"count(*) FROM (SELECT user_id FROM {inter} GROUP BY user_id HAVING count(*) >= {k})" for k in (5, 10, 20)}
    return " UNION ALL ".join(f"SELECT '{run_id}' AS run_id, '{m}' AS metric, (SELECT {c})::DOUBLE AS value, true AS recorded" for m, c in counts.items())


def _recorded(audit: DataFrame) -> DataFrame:
    """An audit with the fact of its time instead of the time."""
    return audit.select("run_id", "metric", "value", F.col("recorded_at").isNotNull().alias("recorded"))


@query(f"""WITH {SQL_DECISIONS}, inter AS (SELECT user_id, accepted_id AS spotify_track_id, count(DISTINCT struct_pack(a := track_name_norm, b := artist_name_norm)) AS merged_listening_key_count FROM listening JOIN decisions USING (track_name_norm, artist_name_norm) WHERE decision = 'accepted' GROUP BY ALL)
{_sql_audit('exact_v1', 'candidates', 'decisions', 'inter', 'spotify_track_id')}""")
def match_audit(spark, sf):
    tracks, listening = _tracks(spark, sf), checkpointed(_listening(spark, sf))
    keys = C.listening_keys(listening)
    candidates = A.match_candidates(keys, tracks, C.track_artists(tracks))
    decisions = A.decide(keys, candidates, "spotify_track_id")
    return _recorded(A.integration_audit("exact_v1", keys, candidates, decisions, A.integrated_interactions(listening, A.crosswalk(decisions), "spotify_track_id"), "spotify_track_id"))


@query(f"WITH {SQL_CLUSTERED} {_sql_audit('feature_cluster_v1', 'lifted', 'cdecisions', 'cinter', 'feature_cluster_id')}")
def cluster_audit(spark, sf):
    listening, keys, _, _, lifted, decisions = _clustered(spark, sf)
    return _recorded(A.integration_audit("feature_cluster_v1", keys, lifted, decisions, A.integrated_interactions(listening, A.crosswalk(decisions), "feature_cluster_id"), "feature_cluster_id"))


@query(f"WITH {SQL_MEMBERS}, wide AS (SELECT DISTINCT feature_cluster_id, coalesce(track_genre, '~') AS genre FROM members) SELECT count(*) AS clusters, (SELECT count(*) FROM members) AS tracks FROM wide")
def genre_fingerprints(spark, sf):
    """The second version of the fingerprint, in which the canonical row's genre takes part: clusters and tracks."""
    tracks = _tracks(spark, sf)
    members = A.fingerprint_members(tracks, C.track_artists(tracks), [*FINGERPRINT, "track_genre"])
    return members.agg(F.count_distinct("feature_cluster_id").alias("clusters"), F.count("*").alias("tracks"))


@query(f"WITH {SQL_ARTISTS} SELECT 'track_id' AS column_name, (SELECT count(*) FROM tracks) AS n, (SELECT count(*) FROM artists a WHERE NOT EXISTS (SELECT 1 FROM tracks t WHERE t.track_id = a.track_id)) AS orphans, (SELECT count(*) FROM tracks WHERE tempo IS NULL) AS null_tempo")
def constraint_counts(spark, sf):
    tracks = _tracks(spark, sf)
    own = K.violations(tracks, K.Constraints(key=["track_id"], not_null=["tempo"]))
    artists = K.violations(C.track_artists(tracks), K.Constraints(foreign={"track_id": (tracks, "track_id")}))
    wide = own.union(artists).agg(F.max(F.when(F.col("constraint_name") == "foreign:track_id", F.col("violations"))).alias("orphans"), F.max(F.when(F.col("constraint_name") == "not_null:tempo", F.col("violations"))).alias("null_tempo"))
    return tracks.agg(F.lit("track_id").alias("column_name"), F.count("*").alias("n")).crossJoin(wide)


# Graph and splits


@query(f"{fx.INTERACTIONS}")
def interactions(spark, sf):
    return _interactions(spark, sf)


def _sql_core(a: int, b: int, rounds: int) -> str:
    parts = [f"g0 AS ({fx.INTERACTIONS})"]
    for i in range(rounds):
        parts.append(f"h{i} AS (SELECT * FROM g{i} WHERE user_id IN (SELECT user_id FROM g{i} GROUP BY user_id HAVING count(*) >= {a}))")
        parts.append(f"g{i + 1} AS (SELECT * FROM h{i} WHERE item_id IN (SELECT item_id FROM h{i} GROUP BY item_id HAVING count(*) >= {b}))")
    return "WITH " + ", ".join(p.replace(" AS (", " AS MATERIALIZED (", 1) for p in parts)


@query(_sql_core(25, 22, 9) + " SELECT user_id, item_id, play_count FROM g9")
def kcore(spark, sf):
    return G.degree_core(_interactions(spark, sf), 25, 22).edges.select("user_id", "item_id", "play_count")


@query(_sql_core(5, 2, 4) + """ SELECT 'retained_rows' AS metric, count(*)::DOUBLE AS value FROM g4 UNION ALL SELECT 'retained_users', count(DISTINCT user_id) FROM g4 UNION ALL SELECT 'retained_items', count(DISTINCT item_id) FROM g4
UNION ALL SELECT 'min_user_degree', min(n) FROM (SELECT count(*) AS n FROM g4 GROUP BY user_id) UNION ALL SELECT 'min_item_degree', min(n) FROM (SELECT count(*) AS n FROM g4 GROUP BY item_id)
UNION ALL SELECT 'iteration_count', """ + " + ".join(f"((SELECT count(*) FROM g{i}) <> (SELECT count(*) FROM g{i + 1}))::INT" for i in range(4)))
def kcore_audit(spark, sf):
    core = G.degree_core(_interactions(spark, sf))
    G.require_core(core.edges, 5, 2)
    return G.core_audit(core)


@query(f"WITH {SQL_SPLIT} SELECT user_id, item_id, split FROM assigned")
def split3(spark, sf):
    return _split(spark, sf).select("user_id", "item_id", "split")


@query(f"""WITH {SQL_SPLIT}, faulty AS (SELECT user_id, CASE WHEN item_id % 41 = 1 THEN -item_id ELSE item_id END AS item_id, CASE WHEN user_id % 7 = 1 AND split = 'test' THEN 'train' WHEN user_id % 5 = 0 THEN 'validation' ELSE split END AS split FROM assigned WHERE item_id % 43 <> 2
  UNION ALL SELECT user_id, item_id, split FROM assigned WHERE item_id % 47 = 3 AND item_id % 43 <> 2 AND item_id % 41 <> 1),
u AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE split = 'train') AS a, count(*) FILTER (WHERE split = 'validation') AS b, count(*) FILTER (WHERE split = 'test') AS c FROM faulty GROUP BY user_id)
SELECT 'missing_rows' AS check_name, count(*) AS violations FROM inter i WHERE NOT EXISTS (SELECT 1 FROM faulty f WHERE f.user_id = i.user_id AND f.item_id = i.item_id)
UNION ALL SELECT 'extra_rows', count(*) FROM faulty WHERE item_id < 0 UNION ALL SELECT 'repeated_rows', count(*) FROM (SELECT 1 FROM faulty GROUP BY user_id, item_id HAVING count(*) > 1)
UNION ALL SELECT 'eligible_users_without_a_part', count(*) FROM u WHERE n >= 20 AND (a = 0 OR b = 0 OR c = 0) UNION ALL SELECT 'sparse_users_held_out', count(*) FROM u WHERE n < 20 AND a < n""")
def split_integrity(spark, sf):
    """The checks on an assignment with known faults: rows missing, extra, repeated, and users without a part."""
    good = checkpointed(_split(spark, sf).select("user_id", "item_id", "split"))
    kept = good.where("item_id % 43 <> 2")
    part = F.when((F.col("user_id") % 7 == 1) & (F.col("split") == "test"), "train").when(F.col("user_id") % 5 == 0, "validation").otherwise(F.col("split"))
    faulty = kept.select("user_id", F.when(F.col("item_id") % 41 == 1, -F.col("item_id")).otherwise(F.col("item_id")).alias("item_id"), part.alias("split"))
    return S.split_integrity(_interactions(spark, sf), faulty.union(kept.where("item_id % 47 = 3 and item_id % 41 <> 1")))


@query(f"""WITH {SQL_SPLIT} SELECT split || '_rows' AS metric, count(*) AS value FROM assigned GROUP BY split UNION ALL SELECT 'evaluation_users', count(DISTINCT user_id) FROM truth
UNION ALL SELECT 'train_users', count(DISTINCT user_id) FROM train UNION ALL SELECT 'train_items', count(DISTINCT item_id) FROM train
UNION ALL SELECT 'held_out_rows_absent_from_train', count(*) FROM assigned WHERE split <> 'train' AND item_id NOT IN (SELECT item_id FROM train) UNION ALL SELECT 'duplicate_assignments', count(*) - count(DISTINCT (user_id, item_id)) FROM assigned""")
def split_audit(spark, sf):
    return S.split_audit(_split(spark, sf))


@query(f"WITH {SQL_SPLIT} SELECT DISTINCT split, item_id FROM assigned a WHERE split <> 'train' AND NOT EXISTS (SELECT 1 FROM train t WHERE t.item_id = a.item_id)")
def cold_items(spark, sf):
    return S.cold_items(_split(spark, sf))


@query(f"""WITH {SQL_INTERACTIONS}, s AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY play_count DESC, sha256(concat_ws(':', 311, user_id, item_id)), item_id) AS place FROM inter)
SELECT user_id, item_id FROM s WHERE n >= 5 AND place = 1""")
def leave_largest_out(spark, sf):
    return S.leave_largest_out(_interactions(spark, sf))[1]


def _sql_hold(take: str) -> str:
    return f"""WITH {SQL_INTERACTIONS}, s AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY sha256(concat_ws(':', 311, user_id, item_id)), item_id) AS place FROM inter)
SELECT user_id, item_id FROM s WHERE n >= 5 AND place <= {take}"""


@query(_sql_hold("greatest(1, least(floor(n * 0.2), n - 1))"))
def split_frac(spark, sf):
    return S.hold_out(_interactions(spark, sf), "frac", 0.2)[1]


@query(_sql_hold("least(3, n - 1)"))
def split_n(spark, sf):
    return S.hold_out(_interactions(spark, sf), "n", n=3)[1]


@query(f"WITH {SQL_USERS} SELECT user_id, country FROM users WHERE country = (SELECT n_name FROM nation WHERE n_nationkey = 3) QUALIFY row_number() OVER (ORDER BY sha256(concat_ws(':', 42, user_id)), user_id) <= greatest(1, round_even(count(*) OVER () * 0.5, 0))")
def country_sample(spark, sf):
    users = C.clean_users(fx.fixture(spark, sf, fx.RAW_USERS))
    name = spark.table("nation").where("n_nationkey = 3").first()["n_name"]
    return S.country_sample(users, name, 0.5).select("user_id", "country")


# Features

SQL_ITEMS = SQL_SPLIT + f", items AS (SELECT * FROM ({fx.ITEMS}) WHERE item_id IN (SELECT item_id FROM train))"
SQL_SCALER = ", " + ", ".join(f"fit_{c} AS (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM items)" for c in CONTINUOUS)
HOTS = {"key": (KEYS, "key", "unknown")}


def _items(spark, sf):
    return fx.fixture(spark, sf, fx.ITEMS).join(_train(spark, sf).select("item_id").distinct(), "item_id", "left_semi")


@query("WITH " + SQL_ITEMS + " " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) AS n FROM items" for c in CONTINUOUS))
def scaler_stats(spark, sf):
    return rounded(X.scaler(_items(spark, sf), CONTINUOUS), "mean", "std")


@query("WITH " + SQL_ITEMS + SQL_SCALER + " SELECT item_id, " + ", ".join(f"round((coalesce({c}, fit_{c}.m) - fit_{c}.m) / fit_{c}.s, 6) + 0.0 AS {c}_z" for c in CONTINUOUS) + ", explicit::INT AS explicit, " + ", ".join(f"coalesce(key = {k}, false)::INT AS key_{k}" for k in KEYS) + ", (key IS NULL)::INT AS key_unknown FROM items, " + ", ".join(f"fit_{c}" for c in CONTINUOUS))
def feature_matrix(spark, sf):
    items = _items(spark, sf)
    return rounded(X.feature_matrix(items, X.scaler(items, CONTINUOUS), CONTINUOUS, ["explicit"], HOTS), *[f"{c}_z" for c in CONTINUOUS])


_Z = ", ".join(f"round((coalesce({c}, {c}_m) - {c}_m) / {c}_s, 6) + 0.0 AS {c}_z" for c in L.CONTINUOUS)
_HOT = ", ".join([*(f"coalesce(key = {k}, false)::INT AS key_{k}" for k in L.KEYS), "(key IS NULL OR key NOT BETWEEN 0 AND 11)::INT AS key_unknown", *(f"coalesce(time_signature = {k}, false)::INT AS time_signature_{k}" for k in L.TIME_SIGNATURES), "(time_signature IS NULL OR time_signature NOT BETWEEN 3 AND 5)::INT AS time_signature_other"])


@query(f"WITH {SQL_TRACKS}, fit AS (SELECT {', '.join(f'avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s' for c in L.CONTINUOUS)} FROM tracks) SELECT track_id AS item_id, {_Z}, coalesce(explicit::INT, 0) AS explicit, coalesce(mode, 0)::INT AS mode, {_HOT} FROM tracks, fit")
def audio_matrix(spark, sf):
    """The experiments' 29 columns over the canonical tracks."""
    items = checkpointed(_tracks(spark, sf).withColumnRenamed("track_id", "item_id"))
    return rounded(X.feature_matrix(items, X.scaler(items, L.CONTINUOUS), L.CONTINUOUS, L.BINARY, L.layout()), *[f"{c}_z" for c in L.CONTINUOUS])


@query("WITH " + SQL_ITEMS + """, broken AS (SELECT item_id, size, key, 1 AS n FROM items UNION ALL SELECT item_id, size, key, 2 FROM items WHERE item_id % 31 = 0)
SELECT 'repeated_ids' AS check_name, count(*) - count(DISTINCT item_id) AS violations FROM broken UNION ALL SELECT 'null_cells', count(*) FILTER (WHERE size IS NULL) FROM broken
UNION ALL SELECT 'bad_key', count(*) FILTER (WHERE key = 5 OR key = 7 AND n = 2) FROM broken""")
def feature_validation(spark, sf):
    """Validation of a matrix with known faults: repeated items, unfilled cells, a missing and a double flag."""
    items = _items(spark, sf)
    faulty = items.withColumn("n", F.lit(1)).union(items.where("item_id % 31 = 0").withColumn("n", F.lit(2)))
    flags = X.one_hot("key", KEYS, "key", "unknown")
    flags["key_5"] = F.lit(0)
    flags["key_8"] = flags["key_8"] + F.coalesce((F.col("key") == 7) & (F.col("n") == 2), F.lit(False)).cast("int")
    matrix = faulty.select("item_id", "size", *[c.alias(n) for n, c in flags.items()])
    return X.validate_matrix(matrix, {"key": [f"key_{k}" for k in [*KEYS, "unknown"]]})


@query("WITH " + SQL_ITEMS + " SELECT genre, count(*) AS items FROM items GROUP BY genre")
def genre_onehot(spark, sf):
    items = _items(spark, sf)
    hots = X.genre_hots(items)
    matrix = X.feature_matrix(items, X.scaler(items, CONTINUOUS), CONTINUOUS, [], hots)
    names = [f"genre_{v}" for v in hots["genre"][0]]
    sums = matrix.agg(*[F.sum(f"`{n}`").alias(n) for n in names]).unpivot([], [F.col(f"`{n}`") for n in names], "genre", "items")
    return sums.select(F.substring("genre", 7, 1000).alias("genre"), "items")


# Neighbours


@query(f"WITH {SQL_SPLIT} SELECT user_id, item_id, round(c, 6) AS c FROM conf")
def confidence(spark, sf):
    return rounded(M.confidence(M.refuse_duplicates(_train(spark, sf))), "c")


@query(f"WITH {SQL_SPLIT}{SQL_BM25} SELECT user_id, item_id, round(c, 6) AS c FROM bm")
def bm25_weights(spark, sf):
    return rounded(M.bm25(M.confidence(_train(spark, sf))), "c")


@query(f"WITH {SQL_SPLIT}{_sql_knn('conf')} SELECT item_id, other_id, rank, round(similarity, 6) AS similarity FROM knn")
def itemknn_cosine(spark, sf):
    return rounded(M.item_neighbours(_train(spark, sf), NEIGHBOURS, min_cooccurrence=2), "similarity")


@query(f"WITH {SQL_SPLIT}{SQL_BM25}{_sql_knn('bm')} SELECT item_id, other_id, rank, round(similarity, 6) AS similarity FROM knn")
def itemknn_bm25(spark, sf):
    return rounded(M.item_neighbours(_train(spark, sf), NEIGHBOURS, weighting="bm25", min_cooccurrence=2), "similarity")


def _knn_frames(spark, sf, weighting="cosine"):
    train = stored(_train(spark, sf), "train")
    similar = stored(M.item_neighbours(train, NEIGHBOURS, weighting=weighting, min_cooccurrence=2), "similar")
    free_shuffles(spark)
    return train, similar


@query(f"WITH {SQL_SPLIT}{_sql_knn('conf')}{SQL_CF}, {_sql_top('cf', where='score > 0')} {SQL_RECS}")
def itemknn_recommend(spark, sf):
    train, similar = _knn_frames(spark, sf)
    return rounded(M.recommend_neighbours(train, similar, TOP), "score")


@query(f"WITH {SQL_SPLIT}{_sql_knn('conf')}{SQL_CF} SELECT user_id, count(*) AS items, round(sum(score), 4) AS total, round(max(score), 6) AS best FROM cf GROUP BY user_id")
def itemknn_raw_scores(spark, sf):
    train, similar = _knn_frames(spark, sf)
    return M.neighbour_scores(train, similar).groupBy("user_id").agg(F.count("*").alias("items"), F.round(F.sum("score"), 4).alias("total"), F.round(F.max("score"), 6).alias("best"))


# Baselines


@query(f"WITH {SQL_SPLIT} SELECT item_id, round(sum(ln(1 + greatest(0.0, play_count))), 6) AS score FROM train GROUP BY item_id")
def popularity(spark, sf):
    return rounded(M.popularity_scores(_train(spark, sf)), "score")


SQL_RANKING = ", ranking AS (SELECT item_id, count(DISTINCT user_id) AS listeners, sum(c) AS s FROM conf GROUP BY item_id)"


@query(f"""WITH {SQL_SPLIT}{SQL_RANKING}, placed AS (SELECT item_id, row_number() OVER (ORDER BY listeners DESC, round(s, 6) DESC, item_id) AS place FROM ranking)
SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY place) AS rank FROM (SELECT DISTINCT user_id FROM truth) u, placed p WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = u.user_id AND t.item_id = p.item_id) QUALIFY rank <= {TOP}""")
def global_popularity(spark, sf):
    return M.recommend_popular(_train(spark, sf), _truth(spark, sf), TOP)


_POP = "SELECT p_partkey AS item_id, CAST(p_size * 2 AS BIGINT) AS popularity FROM part"


@query(f"""WITH {SQL_SPLIT}{SQL_RANKING}, pop AS ({_POP}), target AS (SELECT user_id, least(100, greatest(0, floor(round(sum(c * coalesce(popularity, 0)) / sum(c), 9) + 0.5)))::BIGINT AS target FROM conf LEFT JOIN pop USING (item_id) GROUP BY user_id),
targets AS (SELECT DISTINCT user_id, coalesce(target, 0) AS target FROM truth LEFT JOIN target USING (user_id)),
placed AS (SELECT t.target, r.item_id, row_number() OVER (PARTITION BY t.target ORDER BY abs(coalesce(popularity, 0) - t.target), listeners DESC, round(s, 6) DESC, r.item_id) AS place FROM (SELECT DISTINCT target FROM targets) t, ranking r LEFT JOIN pop p ON r.item_id = p.item_id)
SELECT u.user_id, p.item_id, row_number() OVER (PARTITION BY u.user_id ORDER BY place) AS rank FROM targets u JOIN placed p USING (target) WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = u.user_id AND t.item_id = p.item_id) QUALIFY rank <= {TOP}""")
def history_popularity(spark, sf):
    return M.recommend_history_popularity(_train(spark, sf), _truth(spark, sf), fx.fixture(spark, sf, _POP), TOP)


@query()
def random_baseline(spark, sf):
    return M.recommend_random(_train(spark, sf), _truth(spark, sf), TOP)


# Content


@query(f"WITH {SQL_SPLIT}{SQL_CONTENT} SELECT user_id, list_transform(p, lambda x: round(x, 6) + 0.0) AS profile FROM profiles")
def content_profile(spark, sf):
    profiles = M.content_profiles(_train(spark, sf), _vectors(spark, sf))
    return profiles.select("user_id", F.transform("profile", lambda x: F.round(x, 6) + 0.0).alias("profile"))


@query(f"WITH {SQL_SPLIT}{SQL_CONTENT}, {_sql_top('content')} {SQL_RECS}")
def content_recommend(spark, sf):
    return rounded(M.recommend_content(_train(spark, sf), _vectors(spark, sf), TOP), "score")


SQL_MULTI = SQL_CONTENT + f""", lab AS ({fx.LABELS}), wt AS (SELECT user_id, label, sum(c) AS w FROM own JOIN lab USING (item_id) GROUP BY user_id, label),
share AS (SELECT *, w / sum(w) OVER (PARTITION BY user_id) AS sh FROM wt), cm AS (SELECT user_id, label, list(x ORDER BY d) AS m FROM (SELECT user_id, label, d, sum(c * f[d]) / sum(c) AS x FROM own JOIN lab USING (item_id), range(1, 65) r(d) GROUP BY user_id, label, d) GROUP BY user_id, label),
local AS (SELECT user_id, item_id, list_cosine_similarity(m, f) * sh AS l FROM cm JOIN share USING (user_id, label) JOIN lab USING (label) JOIN vec USING (item_id)),
multi AS (SELECT user_id, item_id, 0.1 * score + 0.9 * coalesce(l, 0) AS score FROM content LEFT JOIN local USING (user_id, item_id))"""


@query(f"WITH {SQL_SPLIT}{SQL_MULTI}, {_sql_top('multi')} {SQL_RECS}")
def multi_interest(spark, sf):
    train = stored(_train(spark, sf), "train")
    return rounded(M.recommend_multi_interest(train, _vectors(spark, sf), fx.fixture(spark, sf, fx.LABELS), TOP), "score")


def _sql_scaled(source: str, name: str) -> str:
    return f"{name} AS (SELECT user_id, item_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS x FROM {source} WINDOW w AS (PARTITION BY user_id))"


SQL_CONTENT_ONLY = SQL_CONTENT


@query(f"WITH {SQL_SPLIT}{_sql_knn('conf')}{SQL_CF}{SQL_CONTENT_ONLY}, {_sql_scaled('cf', 'a')}, {_sql_scaled('content', 'b')}, mixed AS (SELECT user_id, item_id, 0.6 * coalesce(a.x, 0) + 0.4 * coalesce(b.x, 0) AS score FROM a FULL JOIN b USING (user_id, item_id)), {_sql_top('mixed')} {SQL_RECS}")
def hybrid_sparse(spark, sf):
    train, similar = _knn_frames(spark, sf)
    return rounded(M.recommend_hybrid(train, similar, _vectors(spark, sf), TOP, dense=False), "score")


@query(f"WITH {SQL_SPLIT}{_sql_knn('conf')}{SQL_CF}{SQL_CONTENT_ONLY}, whole AS (SELECT user_id, item_id, coalesce(cf.score, 0) AS score FROM content LEFT JOIN cf USING (user_id, item_id)), {_sql_scaled('whole', 'a')}, {_sql_scaled('content', 'b')}, mixed AS (SELECT user_id, item_id, 0.9 * a.x + 0.1 * b.x AS score FROM a JOIN b USING (user_id, item_id)), {_sql_top('mixed')} {SQL_RECS}")
def hybrid_dense(spark, sf):
    train, similar = _knn_frames(spark, sf)
    return rounded(M.recommend_hybrid(train, similar, _vectors(spark, sf), TOP, cf_weight=0.9), "score")


# Metrics

SQL_EVALUATED = """, rel AS (SELECT user_id, count(*) AS relevant FROM truth WHERE user_id IN (SELECT user_id FROM recs) GROUP BY user_id),
hits AS (SELECT user_id, rank FROM recs JOIN truth USING (user_id, item_id)), ks AS (SELECT unnest([10, 20]) AS k),
per AS (SELECT k, r.user_id, relevant, count(h.rank) AS n, coalesce(sum(1 / log2(h.rank + 1)), 0) AS dcg FROM ks, rel r LEFT JOIN hits h ON h.user_id = r.user_id AND h.rank <= k GROUP BY ALL),
exposed AS (SELECT k, count(DISTINCT item_id) AS e FROM ks JOIN (SELECT recs.* FROM recs JOIN rel USING (user_id)) q ON q.rank <= k GROUP BY k)
SELECT k::BIGINT AS k, count(*) AS users, round(avg(n / relevant), 6) AS recall, round(avg(dcg / list_sum(list_transform(range(1, least(k, relevant) + 1), lambda i: 1 / log2(i + 1)))), 6) AS ndcg, round(avg((n > 0)::INT), 6) AS hit_rate,
  round(any_value(e) / (SELECT count(DISTINCT item_id) FROM train), 6) AS coverage, any_value(e) AS exposed_items
FROM per JOIN exposed USING (k) GROUP BY k"""


@query(f"WITH {SQL_SPLIT}{SQL_BM25}{_sql_knn('bm')}{SQL_CF}, {_sql_top('cf', 20, 'score > 0')}{SQL_EVALUATED}")
def evaluate_topk(spark, sf):
    train, similar = _knn_frames(spark, sf, "bm25")
    recs = checkpointed(M.recommend_neighbours(train, similar, 20))
    return rounded(E.evaluate_topk(recs, _truth(spark, sf), train), "recall", "ndcg", "hit_rate", "coverage")


@query(f"WITH {SQL_SPLIT}{_sql_knn('conf')}{SQL_CF}, {_sql_top('cf', TOP, 'score > 0')} SELECT round((SELECT count(DISTINCT item_id) FROM recs) / (SELECT count(DISTINCT item_id) FROM train), 6) AS coverage")
def coverage(spark, sf):
    train, similar = _knn_frames(spark, sf)
    return rounded(E.catalog_coverage(M.recommend_neighbours(train, similar, TOP), train, TOP), "coverage")


@query(f"WITH {SQL_SPLIT}{SQL_CONTENT}, {_sql_top('content')}, f AS (SELECT user_id, rank, f FROM recs JOIN vec USING (item_id)), d AS (SELECT a.user_id, avg(1 - list_cosine_similarity(a.f, b.f)) AS d FROM f a JOIN f b ON a.user_id = b.user_id AND a.rank < b.rank GROUP BY a.user_id) SELECT count(*) AS users, round(avg(d), 6) AS diversity FROM d")
def diversity(spark, sf):
    vectors = _vectors(spark, sf)
    return rounded(E.intra_list_diversity(checkpointed(M.recommend_content(_train(spark, sf), vectors, TOP)), vectors, TOP), "diversity")


@query(f"""WITH {SQL_INTERACTIONS}, s AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY play_count DESC, sha256(concat_ws(':', 311, user_id, item_id)), item_id) AS place FROM inter),
held AS (SELECT user_id, item_id FROM s WHERE n >= 5 AND place = 1), train AS (SELECT user_id, item_id, play_count FROM inter ANTI JOIN held USING (user_id, item_id)), pop AS (SELECT item_id, sum(ln(1 + play_count)) AS score FROM train GROUP BY item_id),
hot AS (SELECT item_id, row_number() OVER (ORDER BY round(score, 9) DESC, item_id) AS place FROM pop), r AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY place) AS rank FROM (SELECT DISTINCT user_id FROM held) u, hot WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = u.user_id AND t.item_id = hot.item_id) QUALIFY rank <= {TOP})
SELECT round(avg((r.rank IS NOT NULL)::INT), 6) AS recall, round(avg(coalesce(1 / log2(r.rank + 1), 0)), 6) AS ndcg FROM held LEFT JOIN r USING (user_id, item_id)""")
def single_truth(spark, sf):
    train, held = S.leave_largest_out(_interactions(spark, sf))
    recs = M.recommend_from_ranking(held, train, M.popularity_scores(train), TOP, F.desc(F.round("score", 9)), "item_id")
    return rounded(E.single_truth_metrics(recs, held, TOP), "recall", "ndcg")


@query(f"""WITH {SQL_SPLIT}{SQL_VEC} SELECT 'train_items_without_features' AS check_name, count(DISTINCT item_id) AS violations FROM train WHERE item_id NOT IN (SELECT item_id FROM vec)
UNION ALL SELECT 'features_without_train_items', count(*) FROM vec WHERE item_id NOT IN (SELECT item_id FROM train) UNION ALL SELECT 'truth_outside_catalog', count(DISTINCT item_id) FROM truth WHERE item_id NOT IN (SELECT item_id FROM train) UNION ALL SELECT 'repeated_train_pairs', 0""")
def experiment_contract(spark, sf):
    return experiment_violations(_train(spark, sf), _truth(spark, sf), _vectors(spark, sf))


@query(f"""WITH {SQL_SPLIT}, lab AS ({fx.LABELS}), n AS (SELECT user_id, count(DISTINCT label) AS n, count(DISTINCT item_id) AS items FROM train JOIN lab USING (item_id) GROUP BY user_id HAVING items >= 5)
SELECT count(*) AS users, round(avg(n), 6) AS mean_clusters, round(median(n), 6) AS median_clusters, round(avg((n = 1)::INT), 6) AS share_one, round(avg((n > 1)::INT), 6) AS share_several FROM n""")
def clusters_touched(spark, sf):
    labels = fx.fixture(spark, sf, fx.LABELS)
    return rounded(M.clusters_touched(_train(spark, sf), labels, 5), "mean_clusters", "median_clusters", "share_one", "share_several")


@query(f"WITH {SQL_SPLIT}, lab AS ({fx.LABELS}) SELECT user_id, label, round(sum(c), 6) AS weight FROM conf JOIN lab USING (item_id) GROUP BY user_id, label")
def cluster_weights(spark, sf):
    return rounded(M.cluster_weights(_train(spark, sf), fx.fixture(spark, sf, fx.LABELS)), "weight")


def _sql_ndcg(n: int, weighting: str) -> str:
    weights, name = ("", "conf") if weighting == "cosine" else (SQL_BM25, "bm")
    return f"SELECT {n}::INT AS neighbours, '{weighting}' AS weighting, ndcg FROM (WITH {SQL_SPLIT}{weights}{_sql_knn(name, n=n)}{SQL_CF}, {_sql_top('cf', 20, 'score > 0')}{SQL_EVALUATED}) WHERE k = 20"


@query("SELECT *, row_number() OVER (ORDER BY ndcg DESC, neighbours::VARCHAR, weighting)::BIGINT AS place FROM (" + " UNION ALL ".join(_sql_ndcg(n, w) for n in (20, 50) for w in ("cosine", "bm25")) + ")")
def grid_ranking(spark, sf):
    train, truth = stored(_train(spark, sf), "train"), stored(_truth(spark, sf), "truth")
    # the nearest 20 are the first of the nearest 50
    similar = {w: stored(M.item_neighbours(train, 50, weighting=w, min_cooccurrence=2), "similar") for w in ("cosine", "bm25")}
    free_shuffles(spark)

    def recommend(neighbours, weighting):
        return M.recommend_neighbours(train, similar[weighting].where(F.col("rank") <= neighbours), 20)

    found = run_grid([{"neighbours": n, "weighting": w} for n in (20, 50) for w in ("cosine", "bm25")], recommend, train, truth, train)
    rows = [(r["config"]["neighbours"], r["config"]["weighting"], round(r["metrics"]["ndcg@20"], 6), i + 1) for i, r in enumerate(found)]
    return spark.createDataFrame(rows, "neighbours int, weighting string, ndcg double, place long")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS events FROM events GROUP BY ALL")
def event_popularity(spark, sf):
    return windowed_popularity(fx.fixture(spark, sf, "SELECT * FROM events")).select("start", "event_type", "events")


# Results of iterative and seeded algorithms: rows and invariants only


@query("SELECT p_partkey, trim(regexp_replace(replace(lower(strip_accents(p_name)), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS key FROM part")
def text_key(spark, sf):
    return fx.fixture(spark, sf, "SELECT p_partkey, p_name FROM part").select("p_partkey", ascii_normalized("p_name").alias("key"))


@query()
def als(spark, sf):
    return rounded(ImplicitALS().fit(_train(spark, sf)).recommend(TOP), "score")


@query()
def mf_sgd(spark, sf):
    return recommend_sgd(checkpointed(_train(spark, sf)), TOP)


@query()
def kmeans(spark, sf):
    return M.catalog_clusters(_vectors(spark, sf), 8)


@query()
def pca(spark, sf):
    return rounded(M.catalog_plane(_vectors(spark, sf)), "x", "y")
