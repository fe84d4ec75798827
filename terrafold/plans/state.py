"""Ordered state: logins, latest positions, debounced clicks, undo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions.text import html_escape
from terrafold.operators import blocks
from terrafold.plans.registry import query
from terrafold.sources.tables import attempts, positions, shares, table
from terrafold.streaming import latest, logins, windows


LOGINS = """WITH RECURSIVE a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, kind, ok) AS k FROM attempts ),
    s AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS TIMESTAMP) AS ts, '' AS told, 0 AS failed_count, false AS is_locked, CAST(NULL AS TIMESTAMP) AS next_challenge, CAST(NULL AS TIMESTAMP) AS passed_at FROM attempts
      UNION ALL SELECT user_id, k, ts, told, CASE WHEN told IN ('Wrong', 'UnauthorizedPleaseWait') THEN failed_count + 1 WHEN told IN ('Locked', 'Success') THEN 0 ELSE failed_count END,
        told = 'Locked' OR is_locked AND told <> 'Unlocked', CASE WHEN told = 'UnauthorizedPleaseWait' THEN ts + INTERVAL 5 MINUTES ELSE next_challenge END, CASE WHEN told = 'CodeRequired' THEN ts ELSE passed_at END
      FROM (SELECT a.user_id, a.k, a.ts, s.failed_count, s.is_locked, s.next_challenge, s.passed_at, CASE WHEN NOT known THEN 'Unknown' WHEN kind = 'unlock' THEN 'Unlocked'
          WHEN kind = 'code' THEN CASE WHEN passed_at IS NULL THEN 'NoBasicAuth' WHEN a.ts - passed_at > INTERVAL 3 MINUTES THEN 'Time Over.' WHEN ok THEN 'Success' ELSE 'NoAuth' END
          WHEN is_locked THEN 'LockedAccount' WHEN next_challenge > a.ts THEN 'PleaseWait' WHEN failed_count = 14 THEN 'Locked'
          WHEN NOT ok THEN CASE WHEN failed_count >= 4 THEN 'UnauthorizedPleaseWait' ELSE 'Wrong' END WHEN second THEN 'CodeRequired' ELSE 'Success' END AS told
        FROM s JOIN a ON a.user_id = s.user_id AND a.k = s.k + 1))
    SELECT user_id, ts, CASE WHEN told IN ('Wrong', 'Unknown') THEN 'Unauthorized' ELSE told END AS outcome, failed_count, is_locked FROM s WHERE k > 0"""


@query(LOGINS)
def login_state(spark: SparkSession, d: str) -> DataFrame:
    return logins.batch(attempts(spark, d))


@query("SELECT user_id, max(ts) AS ts, arg_max(value, ts) AS value FROM positions GROUP BY user_id")
def latest_position(spark: SparkSession, d: str) -> DataFrame:
    return latest.latest(positions(spark, d), "user_id", "ts", "value")


@query(f"SELECT user_id, ts + INTERVAL 3 MINUTES AS ts FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS after FROM ({LOGINS}) WHERE outcome IN ('CodeRequired', 'Success')) WHERE outcome = 'CodeRequired' AND (after IS NULL OR after > ts + INTERVAL 3 MINUTES)")
def login_codes_expired(spark: SparkSession, d: str) -> DataFrame:
    """Codes that were asked for and not given in time."""
    return logins.expired_codes(logins.batch(attempts(spark, d))).select("user_id", "ts")


@query("SELECT user_id, id, expiration AS ts FROM (SELECT *, lead(create_at) OVER (PARTITION BY user_id ORDER BY create_at, id) AS after FROM shares ) WHERE expiration < TIMESTAMP '1998-01-01' AND NOT coalesce(after <= expiration, false)")
def shares_run_out(spark: SparkSession, d: str) -> DataFrame:
    return windows.run_out(shares(spark, d), F.lit("1998-01-01").cast("timestamp_ntz"))


#: Purchases open a window of label clicks and signups one of map clicks; a millisecond stands for 36 seconds, for users of the table seldom click.
_OPENS = {"purchase": windows.LABEL_MS, "signup": windows.MAP_MS}


def click_rows(spark: SparkSession, d: str) -> DataFrame:
    """Clicks and openers of each user."""
    event = F.col("event_type")
    wait = F.coalesce(*(F.when(event == k, F.make_dt_interval(secs=F.lit(36.0 * ms))) for k, ms in _OPENS.items()))
    return table(spark, d, "events").where(event.isin("click", *_OPENS)).select(F.col("user_id").cast("string").alias("key"), "ts", wait.alias("wait"))


@query("SELECT CAST(c.user_id AS VARCHAR) AS key, c.ts FROM (SELECT user_id, ts FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT user_id, ts, to_seconds(36 * CASE event_type WHEN 'purchase' THEN 300 ELSE 700 END) AS wait FROM events WHERE event_type IN ('purchase', 'signup')) o ON c.user_id = o.user_id AND c.ts >= o.ts WHERE o.ts IS NULL OR c.ts >= o.ts + o.wait")
def click_debounce(spark: SparkSession, d: str) -> DataFrame:
    return windows.kept_clicks(click_rows(spark, d))


@query("SELECT DISTINCT user_id, event_type FROM events")
def deletes_once(spark: SparkSession, d: str) -> DataFrame:
    return latest.once(table(spark, d, "events").select("user_id", "event_type"), "user_id", "event_type")


@query("SELECT user_id, max(event_id) AS restored FROM events WHERE event_type = 'error' AND event_id % 3 <> 0 GROUP BY user_id")
def undo_top(spark: SparkSession, d: str) -> DataFrame:
    """What an undo brings back first: each user's last deletion that is not restored yet. Errors stand for deletions, every third of them restored."""
    deleted = table(spark, d, "events").where("event_type = 'error'").select("user_id", "event_id")
    restored = table(spark, d, "events").where("event_id % 3 = 0").select("event_id")
    return deleted.join(restored, "event_id", "left_anti").groupBy("user_id").agg(F.max("event_id").alias("restored"))


#: Lines of documents with marks put in by their number, so that blocks nest, overlap and stay open.
_MARKS = {0: ":::details ", 2: ":::note", 3: ":::", 5: ":::", 6: ":::warning  ", 8: " :::note ", 9: ":::", 10: " ::: ", 11: ":::other", 12: ":::"}
_PERIOD = 14
ESCAPED = "replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;')"
_CHOSEN = " ".join(f"WHEN {k} THEN '{v}'" + (" || substr(line, 1, 9)" if v.strip()[3:] and v.endswith(" ") else "") for k, v in _MARKS.items())
#: A closer is the first later line that brings the level back to what it was before the opener.
BLOCKS = rf"""WITH raw AS (SELECT doc_id, string_split(replace({ESCAPED}, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM documents),
    plain AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM raw),
    numbered AS (SELECT doc_id, 3 * pos + j AS pos, CASE j WHEN 1 THEN line WHEN 2 THEN CASE (doc_id + pos) % {_PERIOD} {_CHOSEN} ELSE line END ELSE CASE (doc_id * 5 + pos * 3) % {_PERIOD} {_CHOSEN} ELSE '' END END AS line FROM plain, (SELECT unnest([1, 2, 3]) AS j)),
    steps AS (SELECT *, CASE WHEN regexp_matches(trim(line), '^:::[A-Za-z0-9_]') THEN 1 WHEN trim(line) = ':::' THEN -1 ELSE 0 END AS step FROM numbered),
    levels AS (SELECT *, sum(step) OVER (PARTITION BY doc_id ORDER BY pos) AS level FROM steps),
    opening AS (SELECT a.doc_id, a.pos, a.line, min(b.pos) AS closed FROM levels a JOIN levels b ON a.doc_id = b.doc_id AND b.pos > a.pos AND b.step = -1 AND b.level = a.level - 1
      WHERE a.step = 1 AND regexp_matches(a.line, '^:::(details|note|warning)') GROUP BY ALL),
    shown AS (SELECT n.doc_id, n.pos, CASE WHEN o.pos IS NOT NULL THEN CASE WHEN starts_with(n.line, ':::details') THEN '<details class="details">' ELSE '<div class="box ' || regexp_extract(n.line, '^:::(note|warning)', 1) || '">' END || chr(10) || '<summary>'
        || CASE WHEN regexp_matches(n.line, '^:::(details|note|warning)\s+.') THEN trim(regexp_extract(n.line, '^:::(?:details|note|warning)\s+(.+)', 1), {{white}}) ELSE upper(regexp_extract(n.line, '^:::(details|note|warning)', 1)) END || '</summary>' || CASE WHEN o.closed = n.pos + 1 THEN chr(10) ELSE '' END
      WHEN c.pos IS NOT NULL THEN CASE WHEN starts_with(c.line, ':::details') THEN '</details>' ELSE '</div>' END || chr(10) ELSE n.line END AS line
      FROM numbered n LEFT JOIN opening o ON o.doc_id = n.doc_id AND o.pos = n.pos LEFT JOIN opening c ON c.doc_id = n.doc_id AND c.closed = n.pos)
    SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY pos)) AS html_md5 FROM shown GROUP BY doc_id"""


@query(BLOCKS.replace("{white}", "' ' || chr(9) || chr(12) || chr(160) || chr(8195)"))
def markdown_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents, with marks put between and in place of their lines."""
    lines = blocks.lines_of(html_escape(F.coalesce("text", F.lit(""))))

    def chosen(line: Column, number: Column, otherwise: Column) -> Column:
        out = F.lit(None).cast("string")
        for k, mark in _MARKS.items():
            titled = bool(mark.strip()[3:]) and mark.endswith(" ")
            out = F.when(number % _PERIOD == k, F.concat(F.lit(mark), F.substring(line, 1, 9)) if titled else F.lit(mark)).otherwise(out)
        return F.coalesce(out, otherwise)

    key = F.col("doc_id")
    more = F.flatten(F.transform(lines, lambda x, k: F.array(x, chosen(x, key + k + 1, x), chosen(x, key * 5 + (k + 1) * 3, F.lit("")))))
    rows = table(spark, d, "documents").select("doc_id", F.array_join(more, "\n").alias("text"))
    return blocks.with_blocks(rows, "text", "html").select("doc_id", F.md5("html").alias("html_md5"))
