"""T1/T2 — anchored windows (cache validity, request limits) without per-key folds.

Semantics, per key, events in time order: the first event opens a window
[a, a + L); every event inside it belongs to that window and counts (n = 1,
2, …); the first event at or after a + L opens the next window.  A cache
hit is n > 1 (key = text fingerprint, L = 24 h); a request is allowed while
n <= limit (key = user, L = 60 s).

The rule is sequential per key, and one key may hold a large share of all
events, so nothing here groups a key into one task:

1. ``global_sort`` range-partitions the events by (key, ts, id) — Spark
   splits a hot key across partitions by time — and numbers them with a
   global position ``_g`` (row number in partition + per-partition offset
   from a partition-sized table).  ``_g`` names an event from here on, so ids
   may be of any type.  Materialised in the shared checkpoint folder.
2. An event at least L after its predecessor certainly starts a window, so
   such events cut each key into sessions.  A session that spans less than L
   is one window; only events of longer sessions go through steps 3 and 4.
3. ``next_at_least``: for each of these, the first event of its session at or
   after ts + L — a forward as-of join done as one more range-sorted scan
   (probes and events interleaved, "last event seen" carried backwards).
4. Window starts are exactly the chain first-event -> next -> next …, followed
   with pointer doubling over the events that have a next one (log2 of the
   longest chain rounds of joins on the unique position; hot keys do not
   matter) and path expansion.
5. Each event's window start is the last start at or before it (a fill
   forward over the global order); n = _g(event) - _g(start) + 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtext.session import materialize

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def micros(col: str) -> Column:
    """Epoch microseconds of a timestamp (with or without zone), zone-independent for NTZ."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, cast({col} as timestamp_ntz))")


def global_sort(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` in total order ``order`` (must be unique), with _pid and a
    0-based global position _g; materialised."""
    # after the range sort each partition is in order, so monotonically_increasing_id
    # (partition index << 33 | row index) already numbers the rows: no second shuffle
    mid = F.monotonically_increasing_id()
    s = df.orderBy(*order).withColumn("_mid", mid)
    s = materialize(s.select("*", F.shiftright("_mid", 33).cast("int").alias("_pid"),
                             F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos")).drop("_mid"))
    sizes = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    # partition-sized table: offset of each partition in the global order
    wo = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select("_pid", F.coalesce(F.sum("_cnt").over(wo), F.lit(0)).alias("_off"))
    return materialize(s.join(F.broadcast(offs), "_pid").withColumn("_g", F.col("_off") + F.col("_pos"))
                       .drop("_off", "_pos"))


def fill_forward(s: DataFrame, order: list[Column], value: Column, out: str) -> DataFrame:
    """On a ``global_sort`` result: ``out`` = last non-null ``value`` at or
    before each row in the global order (carried across partitions)."""
    s = s.withColumn("_v", value)
    w = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("_loc", F.last("_v", ignorenulls=True).over(w))
    tail = s.filter(F.col("_v").isNotNull()).groupBy("_pid").agg(F.max_by("_v", "_g").alias("_last"))
    wc = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = tail.select("_pid", F.last("_last", ignorenulls=True).over(wc).alias("_carry"))
    s = s.join(F.broadcast(carry), "_pid", "left")  # partition-sized table
    return s.withColumn(out, F.coalesce("_loc", "_carry")).drop("_v", "_loc", "_carry")


def next_at_least(ev: DataFrame, length_us: int) -> DataFrame:
    """(g, j) of the events (g, sess, t) that have a later one of their session
    at or after t + L: the first such, by t and g."""
    events = ev.select("sess", "t", F.lit(1).alias("kind"), "g", F.struct("sess", "g").alias("hit"))
    probes = ev.select("sess", (F.col("t") + F.lit(length_us)).alias("t"), F.lit(0).alias("kind"), "g",
                       F.lit(None).cast("struct<sess:long,g:long>").alias("hit"))
    u = events.unionByName(probes)
    # descending order: the last event seen before a probe is the first one after it going forward
    order = [F.col(c).desc() for c in ("sess", "t", "kind", "g")]
    s = fill_forward(global_sort(u, order), order, F.col("hit"), "found")
    return s.filter((F.col("kind") == 0) & (F.col("found.sess") == F.col("sess"))).select("g", F.col("found.g").alias("j"))


def chain_starts(roots: DataFrame, nxt: DataFrame) -> DataFrame:
    """(g) of window starts: the chains root -> j -> … from every root, over
    the pointers (g, j)."""
    jumps = [materialize(nxt)]
    while not jumps[-1].isEmpty():  # pointer doubling: jumps[i].j lies 2^i steps on; short chains drop out
        last = jumps[-1]
        hop = last.select(F.col("g").alias("j"), F.col("j").alias("_far"))
        jumps.append(materialize(last.join(hop, "j").select("g", F.col("_far").alias("j"))))
    starts = roots.select("g")
    for jt in reversed(jumps[:-1]):
        starts = materialize(starts.unionByName(starts.join(jt, "g").select(F.col("j").alias("g"))))
    return starts


def anchored_windows(df: DataFrame, key_col: str, ts_col: str, id_col: str, length_seconds: int) -> DataFrame:
    """Adds window_start (timestamp of the window's first event), window_id
    (that event's id) and n (position of the event in its window, from 1).

    Events are ordered by time, then id; ids may be of any orderable type.
    Rows without key or time belong to no window: they are returned with the
    three columns null.
    """
    length_us = int(length_seconds) * 1_000_000
    known = F.col(key_col).isNotNull() & F.col(ts_col).isNotNull()
    rows = df.select(F.struct(*df.columns).alias("_row"), F.col(key_col).cast("string").alias("key"),
                     micros(ts_col).alias("t"), F.col(id_col).alias("id"), known.alias("_known"))
    order = [F.col("key"), F.col("t"), F.col("id")]
    s = global_sort(rows.filter("_known").drop("_known"), order)
    # predecessor: the row before in the partition, or the last row of the partition before
    here = Window.partitionBy("_pid").orderBy("_g")
    last = s.groupBy("_pid").agg(F.max_by(F.struct("key", "t"), "_g").alias("_end"))
    ends = last.select("_pid", F.lag("_end").over(Window.orderBy("_pid")).alias("_before"))  # partition-sized
    s = s.withColumn("_prev", F.lag(F.struct("key", "t")).over(here)).join(F.broadcast(ends), "_pid", "left")
    prev = F.coalesce("_prev", "_before")
    certain = prev.isNull() | (prev["key"] != F.col("key")) | (F.col("t") - prev["t"] >= F.lit(length_us))
    by_place = [F.col("_g")]
    s = fill_forward(s.withColumn("_cert", certain).drop("_prev", "_before"), by_place, F.when(F.col("_cert"), F.col("_g")), "sess")
    s = materialize(s)
    spans = s.groupBy("sess").agg((F.max("t") - F.min("t")).alias("_span")).filter(F.col("_span") >= length_us)
    long = materialize(s.select(F.col("_g").alias("g"), "sess", "t", "_cert").join(spans.select("sess"), "sess"))
    starts = chain_starts(long.filter("_cert").select("g"), next_at_least(long.select("g", "sess", "t"), length_us))
    starts = starts.select(F.col("g").alias("_g"), F.lit(True).alias("_start")).distinct()
    s = s.join(starts, "_g", "left")
    first = F.when(F.col("_cert") | F.col("_start"), F.struct(F.col("_g").alias("g"), F.col("t").alias("t"), F.col("id").alias("id")))
    s = fill_forward(s, by_place, first, "_w")
    start_ts = F.expr(f"timestampadd(MICROSECOND, _w.t, {EPOCH})")
    out = s.select("_row.*", (F.col("_g") - F.col("_w.g") + 1).alias("n"), F.col("_w.id").alias("window_id"), start_ts.alias("window_start"))
    rest = rows.filter(~F.col("_known")).select("_row.*")
    return out.unionByName(rest, allowMissingColumns=True)


def cache_flags(requests: DataFrame, key_col: str, ts_col: str, id_col: str, ttl_seconds: int) -> DataFrame:
    """cached = a request inside the validity window opened by an earlier miss."""
    return anchored_windows(requests, key_col, ts_col, id_col, ttl_seconds).withColumn("cached", F.col("n") > 1)


def rate_limit(requests: DataFrame, key_col: str, ts_col: str, id_col: str, window_seconds: int, limit: int) -> DataFrame:
    """Allowed while the count in the key's current window is within the limit
    (rejected requests count too)."""
    return anchored_windows(requests, key_col, ts_col, id_col, window_seconds).withColumn("allowed", F.col("n") <= limit)
