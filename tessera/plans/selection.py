"""Selection, sampling and split queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import hash_order, timed_id, yes
from ..operators import select as S
from ..operators import splits
from ..operators.joins import last_of
from .tables import EVENTS_SQL, TAKES_SQL, events, r6, read, takes

EV = f"ev AS ({EVENTS_SQL})"


def time_bin_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best event of each of 12 time bins per user; users of an odd id keep only 4 bins."""
    k = F.when(F.col("user_id") % 2 == 0, 12).otherwise(4)
    return S.time_bins(events(spark, sf_dir), "user_id", ["t", "event_id"], "value", k).select("user_id", "event_id")


TIME_BIN_SQL = f"""WITH {EV}, a AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN 12 ELSE 4 END AS kk FROM ev),
b AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, CASE WHEN user_id % 2 = 0 THEN ntile(12) OVER w ELSE ntile(4) OVER w END AS bin FROM a WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id, CASE WHEN n <= kk THEN event_id ELSE -bin END ORDER BY value DESC, t, event_id) AS rn FROM b) SELECT user_id, event_id FROM c WHERE rn = 1"""


def evenly_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.evenly_spaced(events(spark, sf_dir), "user_id", ["t", "event_id"], 7).select("user_id", "event_id")


EVEN_SQL = f"""WITH {EV}, a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ev)
SELECT user_id, event_id FROM a WHERE n <= 7 OR i IN (SELECT CAST(round_even(j * ((a.n - 1) / 6e0), 0) AS BIGINT) FROM range(7) r(j))"""


def middle_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.middle_row(events(spark, sf_dir), "user_id", ["t", "event_id"]).select("user_id", "event_id")


MIDDLE_SQL = f"WITH {EV}, a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ev) SELECT user_id, event_id FROM a WHERE i = (n - 1) // 2"


def hash_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three documents per language in the order of their seeded hash."""
    return S.hash_first(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 3, "dual:7", ["lang"])


HASH_SQL = "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('dual:7:' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 3"


def stratified_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return S.round_robin(d, ["lang", "source"], "doc_id", 50, "rr").select("doc_id", "lang", "source", "turn")


ROUND_ROBIN_SQL = "SELECT doc_id, lang, source, CAST(turn AS INTEGER) AS turn FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('rr:' || doc_id), doc_id) AS turn FROM documents) ORDER BY turn, lang, source LIMIT 50"


def two_level_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return S.two_level_round_robin(p, "p_brand", "p_type", ["p_partkey"], 60).select("p_partkey", "p_brand", "p_type", "round")


TWO_LEVEL_SQL = """WITH a AS (SELECT p_partkey, p_brand, p_type, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS turn FROM part),
b AS (SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY turn, p_type) AS INTEGER) AS round FROM a) SELECT p_partkey, p_brand, p_type, round FROM b ORDER BY round, p_brand LIMIT 60"""


def balanced_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """140 rows over all users, one more for the first users in hash order."""
    return S.balanced_allocation(events(spark, sf_dir).select("user_id", "event_id"), "user_id", "event_id", 400, "gold").select("user_id", "event_id")


BALANCED_SQL = f"""WITH g AS (SELECT user_id, row_number() OVER (ORDER BY sha256('gold:' || user_id), user_id) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events)),
q AS (SELECT user_id, 400 // n + CASE WHEN place <= 400 % n THEN 1 ELSE 0 END AS quota FROM g),
r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY sha256('gold:' || event_id), event_id) AS rn FROM events) SELECT user_id, event_id FROM r JOIN q USING (user_id) WHERE rn <= quota"""


def quota_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    quota = {"click": 40, "view": 25, "purchase": 15}
    return S.capped_quota(events(spark, sf_dir), "event_type", "user_id", "event_id", quota, 1, "quota").select("event_type", "event_id", "over_cap")


QUOTA_SQL = """WITH a AS (SELECT event_type, user_id, event_id, sha256('quota:' || event_id) AS h, row_number() OVER (PARTITION BY event_type, user_id ORDER BY sha256('quota:' || event_id), event_id) AS g FROM events),
b AS (SELECT *, CAST(g > 1 AS INTEGER) AS over_cap FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY over_cap, h, event_id) AS pick FROM b)
SELECT event_type, event_id, over_cap FROM c WHERE pick <= CASE event_type WHEN 'click' THEN 40 WHEN 'view' THEN 25 WHEN 'purchase' THEN 15 ELSE 0 END"""


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stratified(read(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 90, "strata").select("doc_id", "source")


STRATIFIED_SQL = """WITH a AS (SELECT doc_id, source, sha256('strata:' || doc_id) AS h, row_number() OVER (PARTITION BY source ORDER BY sha256('strata:' || doc_id), doc_id) AS r FROM documents)
SELECT doc_id, source FROM a ORDER BY r > greatest(1, 90 // (SELECT count(DISTINCT source) FROM documents)), h, doc_id LIMIT 90"""


def weighted_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """300 draws with replacement by order price; a draw's point is a hash, so runs repeat."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_totalprice")).alias("w"))
    return S.weighted_draw(o, "o_orderkey", "w", 300, "draw")


WEIGHTED_SQL = """WITH o AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS w, sha256(CAST(o_orderkey AS VARCHAR)) AS h FROM orders WHERE o_totalprice >= 1),
c AS (SELECT o_orderkey, w, CAST(sum(w) OVER (ORDER BY h, o_orderkey) AS BIGINT) AS upto FROM o),
p AS (SELECT range AS draw, CAST(floor(CAST(CAST('0x' || substr(sha256('draw:' || range), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296e0 * (SELECT CAST(sum(w) AS DOUBLE) FROM o)) AS BIGINT) AS x FROM range(300))
SELECT draw, o_orderkey FROM p JOIN c ON x >= upto - w AND x < upto"""


def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.group_split(events(spark, sf_dir), "user_id", 0.2, "split").groupBy("user_id", "split").agg(F.count("*").alias("n"))


SPLIT_SQL = """WITH g AS (SELECT user_id, row_number() OVER (ORDER BY sha256('split:' || user_id), user_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events))
SELECT user_id, CASE WHEN r <= greatest(1, round_even(n * 0.2e0, 0)) THEN 'heldout' ELSE 'train' END AS split, count(*) AS n FROM events JOIN g USING (user_id) GROUP BY 1, 2"""


def stride_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight half-second rows at one-second stride where the size leaves room."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.lit(1.0).alias("s"), (F.col("n_chars") / 200.0).alias("e"))
    got = splits.stride_rows(d, "doc_id", "s", "e", 1.0, 0.5, 8)
    return got.select("doc_id", F.coalesce("row", F.lit(-1)).alias("row"), r6("t", "t"), "status", F.when(F.col("t").isNotNull(), timed_id("doc_id", "t")).alias("sample_id"))


STRIDE_SQL = """WITH a AS (SELECT doc_id, CAST(floor((n_chars / 200e0 - 0.5e0 - 1e0) / 1e0) + 1 AS BIGINT) AS room FROM documents), b AS (SELECT doc_id, room, least(8, greatest(room, 0)) AS n, CASE WHEN room < 1 THEN 'insufficient_duration' WHEN room < 8 THEN 'partial' ELSE 'ok' END AS status FROM a)
SELECT doc_id, CAST(j AS INTEGER) AS row, 1e0 + j AS t, status, doc_id || ':' || printf('%.3f', 1e0 + j) AS sample_id FROM b, range(8) r(j) WHERE j < n UNION ALL SELECT doc_id, -1, NULL, status, NULL FROM b WHERE n = 0"""


def dedup_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return last_of(e, ["user_id", "event_type"], ["t", "event_id"]).select("user_id", "event_type", "event_id")


DEDUP_SQL = f"WITH {EV} SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t DESC, event_id DESC) AS rn FROM ev) WHERE rn = 1"


def role_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that may train: no probe, diagnostic or locked role in any role column."""
    role = F.element_at(F.array(*[F.lit(x) for x in ("train", "Probe-Train", "locked_test", "aux", "Hold-Out")]), (F.col("take_uid") % 5 + 1).cast("int"))
    t = takes(spark, sf_dir).withColumn("role", role).withColumn("flag", F.when(F.col("take_uid") % 7 == 0, "Yes").otherwise("0"))
    bad = splits.forbidden_role(["role", "usable_for"], exact=["hold_out"]) | F.coalesce(yes("flag"), F.lit(False))
    return t.withColumn("bad", bad).groupBy("role", "bad").agg(F.count("*").alias("n"))


QUARANTINE_SQL = f"""WITH t AS (SELECT *, ['train', 'Probe-Train', 'locked_test', 'aux', 'Hold-Out'][take_uid % 5 + 1] AS role FROM ({TAKES_SQL}))
SELECT role, role IN ('Probe-Train', 'locked_test', 'Hold-Out') OR usable_for LIKE '%diagnostic%' OR take_uid % 7 = 0 AS bad, count(*) AS n FROM t GROUP BY 1, 2"""


def dense_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted distinct users as 0..n-1."""
    return S.dense_index(events(spark, sf_dir), "user_id", "code")


DENSE_SQL = "SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS code FROM (SELECT DISTINCT user_id FROM events)"


def published_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest under which an id list is published: sorted ids, a newline after each."""
    return splits.published_digest(read(spark, sf_dir, "documents"), "doc_id")


PUBLISHED_SQL = "SELECT count(*) AS n, sha256(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY CAST(doc_id AS VARCHAR)) || chr(10)) AS digest FROM documents"


def id_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.id_digest(read(spark, sf_dir, "documents"), "doc_id")


DIGEST_SQL = """WITH a AS (SELECT substr(sha256(CAST(doc_id AS VARCHAR)), 1, 2) AS slice, string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY CAST(doc_id AS VARCHAR)) AS ids, count(*) AS n FROM documents GROUP BY 1),
b AS (SELECT slice || ':' || sha256(ids || chr(10)) AS d, n FROM a) SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(d, chr(10) ORDER BY d) || chr(10)) AS digest FROM b"""


def frame_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of half-second spans at 30 per second, counted per user."""
    e = events(spark, sf_dir)
    start = F.col("t") - 1704067200.0
    return e.select("user_id", F.explode(splits.frames_of(start, 0.5, 30.0)).alias("frame")).groupBy("user_id").agg(F.count("*").alias("frames"), F.count_distinct("frame").alias("distinct_frames"))


FRAMES_SQL = f"""WITH {EV}, a AS (SELECT user_id, CAST(round_even((t - 1704067200e0) * 30e0, 0) AS BIGINT) AS f0, CAST(round_even((t - 1704067200e0 + 0.5e0) * 30e0, 0) AS BIGINT) AS f1 FROM ev),
b AS (SELECT user_id, unnest(range(f0, f1 + 1)) AS frame FROM a) SELECT user_id, count(*) AS frames, count(DISTINCT frame) AS distinct_frames FROM b GROUP BY 1"""


def shuffled_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 3n by score, then n of them in hash order."""
    t = takes(spark, sf_dir).select("take_uid", "interaction_score")
    pool = t.orderBy(F.desc("interaction_score"), "take_uid").limit(60)
    return pool.orderBy(hash_order("pool", "take_uid"), "take_uid").limit(20).select("take_uid")


POOL_SQL = f"WITH p AS (SELECT take_uid FROM ({TAKES_SQL}) ORDER BY interaction_score DESC, take_uid LIMIT 60) SELECT take_uid FROM p ORDER BY sha256('pool:' || take_uid), take_uid LIMIT 20"

QUERIES = {
    "time_bin_select": (time_bin_select, TIME_BIN_SQL),
    "evenly_spaced": (evenly_spaced, EVEN_SQL),
    "middle_row": (middle_row, MIDDLE_SQL),
    "hash_ranked": (hash_ranked, HASH_SQL),
    "stratified_round_robin": (stratified_round_robin, ROUND_ROBIN_SQL),
    "two_level_round_robin": (two_level_round_robin, TWO_LEVEL_SQL),
    "balanced_allocation": (balanced_allocation, BALANCED_SQL),
    "quota_cap": (quota_cap, QUOTA_SQL),
    "stratified_sample": (stratified_sample, STRATIFIED_SQL),
    "weighted_draw": (weighted_draw, WEIGHTED_SQL),
    "group_split": (group_split, SPLIT_SQL),
    "stride_rows": (stride_rows, STRIDE_SQL),
    "dedup_keep_last": (dedup_keep_last, DEDUP_SQL),
    "role_quarantine": (role_quarantine, QUARANTINE_SQL),
    "dense_index": (dense_index, DENSE_SQL),
    "id_digest": (id_digest, DIGEST_SQL),
    "published_digest": (published_digest, PUBLISHED_SQL),
    "frame_intervals": (frame_intervals, FRAMES_SQL),
    "shuffled_pool": (shuffled_pool, POOL_SQL),
}
